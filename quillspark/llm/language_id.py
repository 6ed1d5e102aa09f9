"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the byte n-grams (n = 1..4) that both hold, over the
root of the product of their own counts. Nyström landmarks, a few texts of each language, span its feature
space; one-versus-rest kernel ridge regression is solved there from sums over partitions, and texts are
scored by batched matrix products.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, release, saved
from .learning import has_letter, lower_words

#: Bounds of what is learned from: texts and landmarks of each language, and n-grams of the kernel.
TRAIN_TEXTS, LANDMARKS, N_GRAMS = 1500, 24, 8192
LONGEST, PENALTY, SHARPNESS = 4, 1e-3, 4.0
UNKNOWN = "und"
BATCH = 256


def folded(text: str) -> np.ndarray:
    return np.frombuffer(b" " + b" ".join(lower_words(text)) + b" ", np.uint8)


def codes(data: np.ndarray) -> np.ndarray:
    """One number for each byte n-gram: its bytes below, its length above."""
    x = data.astype(np.uint64)
    out, code = [], x
    for n in range(1, LONGEST + 1):
        if len(x) < n:
            break
        if n > 1:
            code = code[:-1] | (x[n - 1 :] << np.uint64(8 * (n - 1)))
        out.append(code | np.uint64(n << 32))
    return np.concatenate(out)


class Grams:
    """Numbers of the kernel's n-grams, by a hash table without clashes: the table is so large that about one
    multiplier in fifty has none, and those of a fixed order are tried until one fits."""

    def __init__(self, chosen: np.ndarray):
        self.chosen = np.concatenate([[np.uint64(0)], chosen])
        bits = max(8, math.ceil(math.log2(max(1, len(chosen) ** 2 / 8))))
        self.shift = np.uint64(64 - bits)
        multipliers = np.random.default_rng(17)
        while True:
            self.multiplier = np.uint64(int(multipliers.integers(1, 1 << 63)) * 2 + 1)
            slots = self.slot(chosen)
            if len(np.unique(slots)) == len(slots):
                break
        self.table = np.zeros(1 << bits, np.uint16 if len(chosen) < 1 << 16 else np.int32)
        self.table[slots] = np.arange(1, len(self.chosen))

    def slot(self, code: np.ndarray) -> np.ndarray:
        return (code * self.multiplier) >> self.shift

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.chosen)), np.float32)
        for row, text in zip(out, texts):
            data = folded(text)
            for at in range(0, len(data), 1 << 20):
                code = codes(data[at : at + (1 << 20) + LONGEST - 1])
                number = self.table[self.slot(code)]
                row[number[self.chosen[number] == code]] = 1
        return out[:, 1:]


@dataclass
class Model:
    languages: list[str]
    chosen: np.ndarray
    landmarks: np.ndarray
    to_scores: np.ndarray

    def __post_init__(self):
        self._grams = None

    def __getstate__(self):
        return self.__dict__ | {"_grams": None}

    def kernel(self, texts: list[str]) -> np.ndarray:
        if self._grams is None:
            self._grams = Grams(self.chosen)
        x = self._grams.presence(texts)
        norm = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(self.landmarks.sum(1), 1))[None]
        return (x @ self.landmarks.T) / norm

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            k = self.kernel(part).astype(np.float64)
            value = np.concatenate([k, np.ones((len(k), 1))], 1) @ self.to_scores
            soft = np.exp(SHARPNESS * (value - value.max(1, keepdims=True)))
            soft /= soft.sum(1, keepdims=True)
            best = soft.argmax(1)
            for text, i, row in zip(part, best.tolist(), soft):
                known = bool(self.languages) and has_letter(text)
                names.append(self.languages[i] if known else UNKNOWN)
                scores.append(float(row[i]) if known else 0.0)
        return names, scores


def _sample(docs: DataFrame, text_col: str, lang_col: str, learn: Column, texts: int) -> tuple[DataFrame, list[str]]:
    """``texts`` distinct texts of each language, or all it has, by their hashes alone: copies do not count."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    distinct = rows.select(lang_col, F.xxhash64(text_col).alias("h")).distinct()
    counts = {r[0]: r[1] for r in distinct.groupBy(lang_col).count().collect()}
    if not counts:
        return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("h")).limit(0), []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * texts / n))])
    hashed = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    few = hashed.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).dropDuplicates(["lang", "h"])
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= texts)
    return saved(ranked.select("lang", "text", "h")), sorted(map(str, counts))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, texts: int = TRAIN_TEXTS, landmarks: int = LANDMARKS, n_grams: int = N_GRAMS) -> Model:
    """Learns from at most ``texts`` distinct texts of each language where ``learn`` holds; null texts and languages
    are left out. Landmarks are the texts of the least hashes; the kernel is over the ``n_grams`` n-grams that most
    landmarks hold, ties by code. Nothing to learn from: no language."""
    prepare(docs.sparkSession)
    sample, languages = _sample(docs, text_col, lang_col, F.lit(True) if learn is None else learn, texts)
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((1, 1)))
    first = sample.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= landmarks)
    chosen_texts = [r["text"] for r in first.select("text").orderBy("lang", "h").collect()]
    counts: Counter = Counter()
    for t in chosen_texts:
        counts.update(np.unique(codes(folded(t))).tolist())
    most = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n_grams]
    grams = Grams(np.array([g for g, _ in most], np.uint64))
    base = grams.presence(chosen_texts)
    m = len(base)
    model = Model(languages, grams.chosen[1:], base, np.zeros((m + 1, len(languages))))
    # K_mm^(-1/2) turns kernel values at the landmarks into features
    values, vectors = np.linalg.eigh(model.kernel(chosen_texts).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = root.shape[1] + 1
        gram, right, n = np.zeros((size, size)), np.zeros((size, len(languages))), 0
        for table in batches:
            names, part = table.column(0).to_pylist(), table.column(1).to_pylist()
            if part:
                f = np.concatenate([model.kernel(part) @ root, np.ones((len(part), 1))], 1)
                y = np.where(np.array(names)[:, None] == np.array(languages)[None], 1.0, -1.0)
                gram, right, n = gram + f.T @ f, right + f.T @ y, n + len(part)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()]), pa.array([n])], names=["gram", "right", "n"])

    sums = sample.select("lang", "text").repartition(8).mapInArrow(normal, "gram binary, right binary, n long").collect()
    gram = sum(np.frombuffer(r["gram"]) for r in sums).reshape(root.shape[1] + 1, -1)
    right = sum(np.frombuffer(r["right"]) for r in sums).reshape(root.shape[1] + 1, -1)
    n = max(1, sum(r["n"] for r in sums))
    solved = np.linalg.solve(gram + PENALTY * n * np.eye(len(gram)), right)
    model.to_scores = np.concatenate([root @ solved[:-1], solved[-1:]])
    return model


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "__lang") -> DataFrame:
    """docs with a struct lang_pred, score (0..1).

    Null texts, texts without a letter, and all texts if nothing was learned: ``und`` with score 0. Other
    columns, null ids and repeated rows are carried along; empty table: no rows.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf(PREDICTION)
    def predictions(texts: pa.Array) -> pa.Array:
        names, scores = model.predict([t or "" for t in texts.to_pylist()])
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=PREDICTION.names)

    return docs.withColumn(out, predictions.asNondeterministic()(F.col(text_col)))
