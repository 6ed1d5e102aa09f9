"""Exact vector search in blocks of queries and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_VECTORS, BLOCK_QUERIES = 50_000, 5_000
#: Queries of one matrix product, and digits that scores are compared at.
STEP, DIGITS = 64, 9


def topk(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "vec_id", query: str = "query_id", embedding: str = "embedding", threshold: float | None = None) -> DataFrame:
    """(query_id, rank from 0, vec_id, score): the k largest inner products, ties to the smaller id; with a
    threshold, only scores from it on. A meeting of two blocks returns at most k rows a query."""
    nv, nq = vectors.count(), queries.count()
    vb, qb = max(1, -(-nv // BLOCK_VECTORS)), max(1, -(-nq // BLOCK_QUERIES))
    left = vectors.select(F.col(vec).cast("long").alias("v"), F.col(embedding).cast("array<double>").alias("e"), F.pmod(F.xxhash64(vec), F.lit(vb)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("j"))
    right = queries.select(F.col(query).cast("long").alias("q"), F.col(embedding).cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vb - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64(query), F.lit(qb)).cast("int").alias("j"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols: list[tuple] = []
        if len(a) and len(b):
            ids, space, qids, asked = a["v"].to_numpy(), np.stack(a["e"]), b["q"].to_numpy(), np.stack(b["e"])
            for at in range(0, len(asked), STEP):
                for q, score in zip(qids[at : at + STEP], np.round(asked[at : at + STEP] @ space.T, DIGITS)):
                    near = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
                    best = near[np.lexsort((ids[near], -score[near]))[:k]]
                    cols.append((np.full(len(best), q), ids[best], score[best]))
        parts = [np.concatenate(x) for x in zip(*cols)] if cols else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts)))

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k).select("query_id", (F.col("__n") - 1).alias("rank"), "vec_id", "score")
    return out if threshold is None else out.where(F.col("score") >= threshold)


def embed(texts: DataFrame, text: str, scorer, out: str = "embedding", batch: int = 64) -> DataFrame:
    """Embeddings by a pluggable function list[str] -> array, in Arrow batches; normalised to length one."""
    schema = texts.select("*").withColumn(out, F.array(F.lit(0.0))).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = part[text].tolist()
            made = [scorer(rows[i : i + batch]) for i in range(0, len(rows), batch)]
            e = np.concatenate(made) if made else np.zeros((0, 1))
            norm = np.linalg.norm(e, axis=1, keepdims=True)
            yield part.assign(**{out: list(e / np.where(norm > 0, norm, 1))})

    return texts.mapInPandas(run, schema)


def hashing_embedder(dim: int = 64):
    """An offline stand-in for a model: signed hashed word counts."""

    def score(texts: list[str]) -> np.ndarray:
        import zlib

        e = np.zeros((len(texts), dim))
        for row, t in zip(e, texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 16 & 1 else -1
        return e

    return score
