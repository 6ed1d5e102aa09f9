"""Session settings that the operators are designed for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and skew handling; conf keys use _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one on one machine."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


#: Documents that cross together between Spark and Python; both hold them, twice at times, in each task.
TOGETHER = 1000


@contextmanager
def small_batches(spark: SparkSession, most: int = TOGETHER) -> Iterator[None]:
    """Fewer rows in an Arrow batch, for what runs inside; the setting is restored."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_tables: list[str] = []


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``saved`` wrote inside: for work whose results are written elsewhere or collected by its end."""
    before = len(_tables)
    try:
        yield
    finally:
        for path in _tables[before:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _tables[before:]


def saved(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, whoever reads them and whatever is lost."""
    path = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
