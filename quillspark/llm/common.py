"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python: texts are long, so batches are kept small.
BATCH_ROWS = 1000
_tables: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and let executors import this package from the driver's path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only on one machine, and only where neither the setting nor a checkpoint directory exists (as in tests), is a
    temporary folder made; on a cluster its absence is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows as a Parquet table in the shared folder, which outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillspark-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Deletes the tables that ``saved`` has written, from number ``since`` on (see ``written``), ``upto`` one.
    Results that still read them must have been written or collected."""
    for path in _tables[since:upto]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _tables[since:upto]


def written() -> int:
    """How many tables ``saved`` has written that are not discarded."""
    return len(_tables)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(column: str, modulus: int):
    """crc32 of the id as text, modulo: the fold that the contracts use (null ids: 0 bytes)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and what its allocators keep counts
    against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries trim by themselves
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, releasing memory at the end of the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def drawn(rows: DataFrame, n: int, wanted: int, seed: int = 1) -> DataFrame:
    """About ``wanted`` of n rows, whatever n is; all if there are fewer. Equal rows are drawn one by one."""
    return rows.where(F.rand(seed) < min(1.0, wanted / max(1, n)))


def unique_key(docs: DataFrame, key: str) -> bool:
    """True if the key has neither nulls nor repeats (one narrow pass over the id column)."""
    row = docs.groupBy(key).count().agg(F.max("count").alias("most"), F.max(F.col(key).isNull().cast("int")).alias("none")).first()
    return (row["most"] or 0) <= 1 and not row["none"]
