"""Toxicity by compression distance.

Two zstandard dictionaries are built of the learned texts: one of what tells toxic documents, one of ordinary text.
Which strings tell is decided by a likelihood ratio, not by a dictionary trainer (the README gives figures of both).
Each window of a text, a word between its spaces, is compressed with both; where the toxic dictionary is shorter by the
calibrated number of bytes, the window counts, as often as it stands there. The largest count over any run of
PASSAGE words (or over a shorter text), over the root of that length, is calibrated to a score by weighted
isotonic regression; so the rest of a long document does not dilute a toxic passage.

Dictionaries share their ordinary part and differ in as many bytes of contrast: the toxic one holds the
strings that set toxic documents apart (all of them, by likelihood ratio of document counts), the ordinary one
its first bytes again. Words stand between two constant strings that both dictionaries hold, so that even a short
word is compressed, not stored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare
from .learning import isotonic, labelled_sample, lower_words

#: Bound of the labelled rows that are learned from, by label.
TRAIN_ROWS = {1: 1500, 0: 3000}
THRESHOLD = 0.7
SHARED_BYTES, LEAST_RATIO, LEAST_DOCS = 6000, 15.0, 5
LENGTHS = range(5, 10)
#: Words of a passage, and what is added to its length under the root (chosen by the error on learned rows of sf0.1).
PASSAGE, ADDED = 200, 20
BEFORE, AFTER = bytes(range(1, 13)), bytes(range(13, 29))
#: Windows that a worker remembers before it starts anew, and their most bytes.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64


def window(word: bytes) -> bytes:
    return BEFORE + b" " + word + b" " + AFTER


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    least_gain: int = 1
    nodes: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        import zstandard

        out = []
        for content in (self.ordinary, self.toxic):
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(5, min_match=5, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
            kept.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(dict_data=kept, compression_params=how).compress)
        return out

    def gains(self, words: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves over the ordinary one, window by window."""
        if self._ready is None:
            self._ready = (*self._compressors(), {})
        ordinary, toxic, known = self._ready
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        new = {w: len(ordinary(x)) - len(toxic(x)) for w in dict.fromkeys(words) if w not in known for x in (window(w),)}
        known.update((w, g) for w, g in new.items() if len(w) <= LONGEST_REMEMBERED)
        return [known[w] if w in known else new[w] for w in words]

    def rate(self, text: str, least: int | None = None) -> float:
        words = lower_words(text)
        least = self.least_gain if least is None else least
        hits = np.array(self.gains(words), np.int64) >= least
        if not hits.any():
            return 0.0
        n = min(len(words), PASSAGE)
        upto = np.concatenate([[0], np.cumsum(hits)])
        return int((upto[n:] - upto[:-n]).max()) / math.sqrt(n + ADDED)

    def score(self, text: str) -> float:
        return float(np.clip(np.interp(self.rate(text), self.nodes, self.values), 0.0, 1.0))


def _starts(words: set[bytes]) -> set[bytes]:
    """First bytes of words, with the space before (and after, where the word ends)."""
    return {s[:n] for s in (b" " + w + b" " for w in words) for n in LENGTHS if len(s) >= n}


def contrast(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Strings that set toxic documents apart, most telling first; none contains another as its start."""
    a: Counter = Counter()
    b: Counter = Counter()
    for docs, counts in ((toxic, a), (ordinary, b)):
        for words in docs:
            counts.update(_starts(set(words)))
    n, m = len(toxic), len(ordinary)

    def likelihood(k: int, of: int, p: float) -> float:
        return k * math.log(max(p, 1e-12)) + (of - k) * math.log(max(1 - p, 1e-12))

    def ratio(x: int, y: int) -> float:
        p = (x + y) / (n + m)
        return 2 * (likelihood(x, n, x / n) + likelihood(y, m, y / max(m, 1)) - likelihood(x, n, p) - likelihood(y, m, p))

    telling = [s for s in a if a[s] >= LEAST_DOCS and a[s] * (m + 1) > 4 * n * (b[s] + 1)]
    ranked = sorted(((ratio(a[s], b[s]), s) for s in telling), key=lambda x: (-x[0], x[1]))
    picked: list[bytes] = []
    for value, s in ranked:
        if value < LEAST_RATIO:
            break
        if not any(s.startswith(q) for q in picked):
            picked = [q for q in picked if not q.startswith(s)] + [s]  # a start stands for all that go on from it
    longer = []
    for q in picked:  # the longest string that nearly as many toxic documents have
        longer.append(max((s for s in telling if s.startswith(q) and a[s] >= 0.9 * a[q]), key=lambda s: (len(s), s), default=q))
    return longer


def train(texts: list[str], y: list[int], weights: dict[int, float]) -> Model:
    """Dictionaries from three quarters of the labelled texts, by a hash of the text, so that copies stay together;
    gain threshold and calibration from the last quarter, which the dictionaries have not seen. Where that quarter
    lacks a label, all texts serve for both. Equal texts count once for contrast."""
    last = [zlib.crc32(t.encode("utf-8", "replace")) % 4 == 0 for t in texts]
    if {k for k, z in zip(y, last) if z} != {0, 1} or {k for k, z in zip(y, last) if not z} != {0, 1}:
        return _train(texts, y, texts, y, weights)
    parts = [[(t, k) for t, k, z in zip(texts, y, last) if z == w] for w in (False, True)]
    return _train(*(list(x) for p in parts for x in zip(*p)), weights)


def _train(texts: list[str], y: list[int], kept_out: list[str], kept_y: list[int], weights: dict[int, float]) -> Model:
    seen: dict[str, int] = {}
    for t, k in zip(texts, y):
        seen.setdefault(t, k)
    words = {t: lower_words(t) for t in seen}
    toxic, ordinary = [words[t] for t, k in seen.items() if k], [words[t] for t, k in seen.items() if not k]
    if not toxic or not ordinary:
        return Model(b"", b"", 1, np.zeros(1), np.full(1, float(bool(toxic))))
    common = [w for w, _ in sorted(Counter(w for d in ordinary for w in d).items(), key=lambda x: (-x[1], x[0]))[:6000]]
    telling = b"".join(contrast(toxic, ordinary)) or b" "
    text = b" ".join(common)
    shared, filler = text[:SHARED_BYTES], (text[:SHARED_BYTES] + b" " * len(telling))[: len(telling)]
    end = BEFORE + b"~" + AFTER
    model = Model(shared + telling + end, shared + filler + end)
    truth = np.array(kept_y, np.float64)
    w = np.array([weights.get(int(k), 1.0) for k in kept_y])
    best = None
    for least in range(1, 7):
        rates = np.array([model.rate(t, least) for t in kept_out])
        nodes, values = isotonic(rates, truth, w)
        # the threshold whose calibrated scores leave the least squared error
        error = float((w * (np.interp(rates, nodes, values) - truth) ** 2).sum())
        if best is None or error < best[0]:
            best = error, least, nodes, values
    _, model.least_gain, model.nodes, model.values = best
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: dict[int, int] | None = None) -> Model:
    """Learns from at most ``rows`` labelled rows of each label where ``learn`` holds; see ``labelled_sample`` for
    nulls, repeats and ties. Without rows of both labels every score is 0 (or 1, if all are toxic)."""
    prepare(docs.sparkSession)
    sample, weights = labelled_sample(docs, labels, label, learn, rows or TRAIN_ROWS)
    got = sample.select("id", "text", "y").toArrow().sort_by("id")
    return train(got["text"].to_pylist(), got["y"].to_pylist(), weights)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "__toxicity") -> DataFrame:
    """docs with a struct that holds ``score``, 0..1. Null texts score as empty ones; other columns, whatever their
    names, null ids and repeated rows are carried along; empty table: no rows."""
    prepare(docs.sparkSession)

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(out, F.struct(scores(F.col(text_col)).alias("score")))
