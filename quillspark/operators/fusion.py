"""Reciprocal rank fusion and what follows it: files in fused order, merged chunks, unique documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DIGITS = 9


def keyed(rows: DataFrame, out: str = "doc", **columns: str) -> DataFrame:
    """rows with ``document_key`` as the column that ``fuse`` goes by, for lists whose rows have no number."""
    return rows.withColumn(out, document_key(**columns))


def document_key(chunk: str = "chunk_id", file: str = "source_file", index: str = "chunk_index"):
    """The chunk's id, or where it has none its file and place (empty and 0 where these are null too)."""
    return F.coalesce(F.nullif(F.col(chunk), F.lit("")), F.concat_ws("_", F.coalesce(F.col(file), F.lit("")), F.coalesce(F.col(index), F.lit(0)).cast("string")))


def fuse(ranked: DataFrame, key: str = "doc", k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, rank from 0) from lists (query_id, list_idx, rank, key): sum of 1/(k + rank + 1).

    A key that repeats in a list adds up. Ties: what was seen first, by list and rank.
    """
    summed = ranked.groupBy("query_id", key).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank") + 1)), DIGITS).alias("score"), F.min(F.struct("list_idx", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", key)
    return summed.withColumn("rank", F.row_number().over(order) - 1).select("query_id", key, "score", "rank")


def unique_files(fused: DataFrame, limit: int, file: str = "source_file") -> DataFrame:
    """Rows of the first ``limit`` files of each query in fused order, with ``file_rank`` from 1. Rows without a
    file are one file."""
    named = fused.withColumn(file, F.coalesce(file, F.lit("")))
    led = named.withColumn("lead", F.min("rank").over(Window.partitionBy("query_id", file)))
    return led.withColumn("file_rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy("lead"))).where(F.col("file_rank") <= limit).drop("lead")


def merged(rows: DataFrame, most: int = 2, file: str = "source_file") -> DataFrame:
    """One row for each query and file: its ``most`` best chunks by fused rank, in order of chunk_index, joined by
    an empty line; other columns from the best one; merged_chunks null for a single chunk; fusion_score, the best
    chunk's score at four digits, where rows have a score."""
    if "score" in rows.columns:
        rows = rows.withColumn("fusion_score", F.round("score", 4))
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", file).orderBy("rank"))).where(F.col("place") <= most)
    parts = F.sort_array(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), F.col("rank").alias("r"), "text")))
    keep = [c for c in rows.columns if c not in ("query_id", file, "text", "rank")]
    out = best.groupBy("query_id", file).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("n"), F.min_by(F.struct(*keep), F.col("rank")).alias("best"), F.min("rank").alias("rank"))
    return out.select("query_id", file, "text", "rank", "best.*", F.when(F.col("n") > 1, F.col("n")).alias("merged_chunks"))


def first_by_file(ranked: DataFrame, k: int = 5, file: str = "source_file") -> DataFrame:
    """The first row of each file in rank order, k a query; rank is counted anew."""
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("query_id", file).orderBy("rank"))).where("r <= 1").drop("r")
    numbered = first.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("__n") <= k)
    return numbered.withColumn("rank", F.col("__n") - 1).drop("__n")
