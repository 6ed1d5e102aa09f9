"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample; rules run by rejections per cost, and
a document that a rule rejects is not shown to the next one. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, prepare, text_bytes

SAMPLE_ROWS = 1000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


@dataclass
class Doc:
    """A text and its base figures."""

    text: bytes
    words: list[bytes]
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more (exact, by word numbers)."""
    n = len(words)
    if n <= size:
        return 0
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    ids = np.array([put(w, len(numbers)) for w in words], np.int64)
    code, span = ids[: n - size + 1], len(numbers)
    for i in range(1, size):
        if span > (1 << 62) // len(numbers):
            _, code = np.unique(code, return_inverse=True)
            span = len(code)
        code = code * len(numbers) + ids[i : n - size + 1 + i]
        span *= len(numbers)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, np.int64)
    hit = order[np.r_[same, False] | np.r_[False, same]]
    np.add.at(twice, hit, 1)
    np.subtract.at(twice, hit + size, 1)
    return int((np.cumsum(twice)[:n] > 0).sum())


def base(text: bytes) -> Doc:
    lines = [x for x in text.split(b"\n") if x.strip()]
    words = text.split()
    return Doc(text, words, len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(words))


def word_chars(text: bytes, words: list[bytes]) -> int:
    return sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.decode("utf-8", "replace")))


def too_many_symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > len(d.words)


def repeated_lines(d: Doc) -> bool:
    return 2 * d.n_dup_lines > d.n_lines


def shouting(d: Doc) -> bool:
    letters = len(d.text) - len(d.text.translate(None, LETTERS))
    return 2 * (len(d.text) - len(d.text.translate(None, UPPER))) > letters


def odd_word_length(d: Doc) -> bool:
    chars, n = word_chars(d.text, d.words), len(d.words)
    return chars < 2 * n or chars > 15 * n


def one_word_rules(d: Doc) -> bool:
    return len(d.words) >= 20 and 10 * Counter(d.words).most_common(1)[0][1] > 3 * len(d.words)


def few_letters(d: Doc) -> bool:
    """Words without an ASCII letter or a byte of a longer character make up half or more."""
    return 2 * sum(w.translate(None, LETTERS) == w and w.isascii() for w in d.words) >= len(d.words)


RULES: dict[str, Callable[[Doc], bool]] = {
    "too_many_symbols": too_many_symbols,
    "repeated_lines": repeated_lines,
    "shouting": shouting,
    "odd_word_length": odd_word_length,
    "one_word_rules": one_word_rules,
    "few_letters": few_letters,
}


def base_failed(d: Doc) -> bool:
    return len(d.words) < MIN_WORDS or 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * len(d.words)


def measure(docs: DataFrame, text_col: str, rules: dict, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, nanoseconds per document, share rejected) on about ``rows`` documents, all rules on each."""
    sample = drawn(docs.select(text_col), docs.count(), rows)

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, seen = dict.fromkeys(rules, 0), dict.fromkeys(rules, 0), 0
        for table in batches:
            known = [d for d in map(base, text_bytes(table.column(0))) if not base_failed(d)]
            seen += len(known)
            for name, rule in rules.items():
                t = time.perf_counter_ns()
                hits[name] += sum(map(rule, known))
                spent[name] += time.perf_counter_ns() - t
        yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(list(spent.values()), pa.int64()), pa.array(list(hits.values()), pa.int64()), pa.array([seen] * len(rules), pa.int64())], names=["rule", "ns", "hits", "n"])

    got = sample.mapInArrow(trial, "rule string, ns long, hits long, n long").groupBy("rule").agg(F.sum("ns"), F.sum("hits"), F.sum("n")).collect()
    return [(r[0], r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in got]


def plan(measured: list[tuple[str, float, float]], rules: dict) -> list[str]:
    """Rules by rejections per cost, highest first; unmeasured ones and ties by name."""
    rate = {name: hits / max(ns, 1.0) for name, ns, hits in measured}
    return sorted(rules, key=lambda r: (-rate.get(r, 0.0), r))


FIGURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())]
)


def judge(docs: DataFrame, text_col: str = "text", rules: dict | None = None, out: str = "__rules") -> DataFrame:
    """docs with a struct of base figures, base_failed, kept and rejected_by (null if kept or base_failed).

    Null and empty texts: all figures zero, base_failed. Other columns, null ids and repeated rows are carried
    along as they are. Empty table: no rows. base_failed and kept depend on the text only; rejected_by names the first
    rule that rejects it, in an order that follows times measured in this run, and may differ from run to run.
    """
    prepare(docs.sparkSession)
    rules = rules or RULES
    order = plan(measure(docs, text_col, rules), rules)

    @F.arrow_udf(FIGURES)
    def verdicts(texts: pa.Array) -> pa.Array:
        cols: list[list] = [[] for _ in FIGURES.names]
        alive: list[tuple[int, Doc]] = []
        for i, text in enumerate(text_bytes(texts)):
            d = base(text)
            failed = base_failed(d)
            for c, v in zip(cols, (len(d.words), word_chars(text, d.words), d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, not failed, None)):
                c.append(v)
            if not failed:
                alive.append((i, d))
        for name in order:
            rule, left = rules[name], []
            for i, d in alive:
                if rule(d):
                    cols[6][i], cols[7][i] = False, name
                else:
                    left.append((i, d))
            alive = left
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=FIGURES.names)

    return docs.withColumn(out, verdicts(F.col(text_col)))
