"""Labelled samples and calibration, shared by the classifiers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ASCII letters lower-case, other ASCII to spaces; bytes of longer characters stay.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_ascii_letter = re.compile("[A-Za-z]").search


def lower_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split()


def has_letter(text: str) -> bool:
    return bool(_ascii_letter(text)) or any(c.isalpha() for c in text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int | dict[int, int], id_col: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """(id, text, y) of a bounded sample, and each label's weight (labelled rows over sampled rows).

    rows bounds the sample: in all, or for each label. The ids with the smallest hashes are taken, whatever the
    partitions. Null labels and ids are left out; an id that is labelled twice has its least label; of documents
    with one id the one whose text has the least MD5 stays, so the bound holds for rows too; null texts are empty.
    No labels: no rows.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & learn).groupBy(id_col).agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    hashed = known.orderBy(F.xxhash64(id_col), id_col)
    if isinstance(rows, int):
        picked = hashed.limit(rows)
        share = min(1.0, rows / max(1, sum(counts.values())))
        weights = dict.fromkeys(counts, 1 / share)
    else:
        parts = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n) for y, n in rows.items()]
        picked = parts[0]
        for p in parts[1:]:
            picked = picked.unionByName(p)
        weights = {y: counts.get(y, 0) / max(1, min(n, counts.get(y, 0))) for y, n in rows.items()}
    # the picked side holds ``rows`` rows of two numbers at most
    joined = docs.select(id_col, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    one = joined.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.md5("text")))).where("__n = 1")
    return one.select(F.col(id_col).alias("id"), "text", "y"), weights


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the non-decreasing least-squares fit (pool adjacent violators); empty input: one node at 0."""
    if not len(x):
        return np.zeros(1), np.zeros(1)
    values, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse, w)
    mean = np.bincount(inverse, w * y) / weight
    pools: list[list[float]] = []  # mean, weight, first, last
    for i, (m, k) in enumerate(zip(mean.tolist(), weight.tolist())):
        pools.append([m, k, i, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, k2, _, last = pools.pop()
            top = pools[-1]
            top[0], top[1], top[3] = (top[0] * top[1] + m2 * k2) / (top[1] + k2), top[1] + k2, last
    xs, ys = [], []
    for m, _, a, b in pools:
        xs += [values[a], values[b]] if b > a else [values[a]]
        ys += [m, m] if b > a else [m]
    return np.array(xs), np.array(ys)
