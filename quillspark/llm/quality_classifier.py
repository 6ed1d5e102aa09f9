"""Quality scores: ridge regression on random Fourier features of document statistics.

The features cos(Wx + b) approximate a Gaussian kernel over standardised statistics. Partitions sum their
own normal equations; only the sums travel. Part of the labelled rows is kept out of the regression and
calibrates its values to probabilities by isotonic regression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_rules
from .common import prepare, saved, text_bytes
from .learning import isotonic, labelled_sample

#: Bound of the labelled rows that are learned from, features, ridge penalty and seed.
TRAIN_ROWS, FEATURES, PENALTY, SEED = 12000, 256, 1e-3, 11
THRESHOLD = 0.3
DIGITS = b"0123456789"


def statistics(text: bytes) -> list[float]:
    """What a score is made of. Three figures are bounded, so that one odd text cannot stretch the scale of its
    feature: mean word length (30), symbols a word (4), bars and exclamation marks a word (2)."""
    d = quality_rules.base(text)
    n, size = max(1, len(d.words)), max(1, len(text))
    letters = len(text) - len(text.translate(None, quality_rules.LETTERS))
    upper = len(text) - len(text.translate(None, quality_rules.UPPER))
    counts = Counter(d.words)
    return [
        math.log1p(len(d.words)),
        math.log1p(d.n_lines),
        min(30.0, quality_rules.word_chars(text, d.words) / n),
        math.sqrt(min(4.0, d.n_symbols / n)),
        math.sqrt(min(2.0, text.count(b"|") / n)),
        math.sqrt(min(2.0, text.count(b"!") / n)),
        math.sqrt(d.n_dup_lines / max(1, d.n_lines)),
        math.sqrt(d.n_repeat_words / n),
        math.sqrt(upper / max(1, letters)),
        math.sqrt((len(text) - len(text.translate(None, DIGITS))) / size),
        len(counts) / n,
        math.sqrt(max(counts.values(), default=0) / n),
        math.sqrt(sum(a == b for a, b in zip(d.words, d.words[1:])) / n),
        letters / size,
    ]


N_STATISTICS = len(statistics(b""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    nodes: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        waves = np.cos(((x - self.mean) / self.scale) @ self.waves + self.phase) * math.sqrt(2 / len(self.phase))
        return np.concatenate([waves, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.nodes, self.values), 0.0, 1.0)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(b) for b in text_bytes(texts)], pa.list_(pa.float64()))


def _rows(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.array(table.column(0).to_pylist(), np.float64).reshape(-1, N_STATISTICS), np.array(table.column(1).to_pylist(), np.float64)


def _sums(df: DataFrame, part) -> list[np.ndarray]:
    """Sums over partitions of the arrays that part(x, y) gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for table in batches:
            x, y = _rows(table)
            if len(x):
                got = part(x, y)
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.float64).tobytes() for a in total], pa.binary()), pa.array(range(len(total)), pa.int32())], names=["sum", "k"])

    out: dict[int, np.ndarray] = {}
    # the sample is bounded, so eight partitions' sums suffice and bound what is collected
    for r in df.select("x", "y").coalesce(8).mapInArrow(run, "sum binary, k int").collect():
        got = np.frombuffer(r["sum"], np.float64)
        out[r["k"]] = out.get(r["k"], 0.0) + got
    return [out[k] for k in sorted(out)]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = TRAIN_ROWS, features: int = FEATURES, penalty: float = PENALTY, seed: int = SEED) -> Model:
    """Learns from at most ``rows`` labelled rows where ``learn`` holds; see ``labelled_sample`` for nulls, repeats
    and ties. Three quarters of them, by a hash of the id, fit the regression, the others calibrate it. Without
    labelled rows every score is 0."""
    prepare(docs.sparkSession)
    sample, _ = labelled_sample(docs, labels, label, learn, rows)
    sample = saved(sample.select("id", _statistics("text").alias("x"), "y"))
    ridge = sample.where(F.pmod(F.xxhash64("id"), F.lit(4)) != 0)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), rng.normal(0, 1 / math.sqrt(N_STATISTICS), (N_STATISTICS, features)), rng.uniform(0, 2 * math.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))
    moments = _sums(ridge, lambda x, y: [np.array([float(len(x))]), x.sum(0), (x * x).sum(0)])
    if not moments:
        return model
    n = moments[0][0]
    model.mean = moments[1] / n
    model.scale = np.sqrt(np.maximum(moments[2] / n - model.mean**2, 1e-6))

    def normal(x, y, m=model):
        f = m.features(x)
        return [(f.T @ f).ravel(), f.T @ y]

    gram, right = _sums(ridge, normal)
    gram = gram.reshape(features + 1, features + 1)
    model.weights = np.linalg.solve(gram + penalty * n * np.eye(features + 1) / features, right)
    held = sample.where(F.pmod(F.xxhash64("id"), F.lit(4)) == 0).select("x", "y").toArrow()
    x, y = np.array(held["x"].to_pylist(), np.float64).reshape(-1, N_STATISTICS), np.array(held["y"].to_pylist(), np.float64)
    model.nodes, model.values = isotonic(model.raw(x), y, np.ones(len(y)))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "__quality") -> DataFrame:
    """docs with a struct that holds ``score``, 0..1. Null texts score as empty ones; other columns, whatever their
    names, null ids and repeated rows are carried along; empty table: no rows."""
    prepare(docs.sparkSession)

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(b) for b in text_bytes(texts)], np.float64).reshape(-1, N_STATISTICS)
        return pa.array(model.score(x))

    return docs.withColumn(out, F.struct(scores(F.col(text_col)).alias("score")))
