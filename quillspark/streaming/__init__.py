"""Incremental counterparts: chunks that arrive as files, and annotations by latest entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import CHUNK_SCHEMA


def chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CHUNK_SCHEMA).json(path).select("id", "text", "metadata.*")


def append_new(stream: DataFrame, target: str, checkpoint: str):
    """Appends chunks whose id the table does not hold yet; ids repeat within a batch once."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["id"])
        try:
            fresh = fresh.join(spark.read.parquet(target).select("id"), "id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(annotations: DataFrame, key: str = "key", at: str = "timestamp") -> DataFrame:
    """The newest annotation of each key."""
    return annotations.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("r = 1").drop("r")
