"""BM25 over an inverted index of plain tables: postings, document lengths and term weights."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


from ..session import saved, small_batches

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Scores are compared at this many digits: sums in another order must not reorder ties.
DIGITS = 6
#: Rows of a few numbers and a term at most that are sent to all tasks.
FEW = 500_000
#: Layout of a saved index.
VERSION = 2
#: Queries times terms of a table of weights that each task holds (32 MB), and cells of what it adds up at once.
DENSE, CELLS = 1 << 22, 1 << 19
#: Documents whose counts are handed on together.
SLICE = 256
#: Words as ``functions.text.tokens`` has them, of lower-case text: letters and numbers of all scripts, and underscores.
_words = re.compile(r"\w{3,}").findall


@dataclass
class Index:
    postings: DataFrame  # term, doc, tf, dl
    terms: DataFrame  # term, df, idf
    totals: DataFrame  # one row: n_docs, avgdl
    packed: DataFrame | None = None  # doc, dl, words, tfs: what postings are made of
    unique: bool = False  # whether ``packed`` is known to hold one row for each document

    def saved(self, path: str) -> "Index":
        """The index as it is read back from ``path``: documents are tokenised once."""
        self.save(path)
        return load(self.totals.sparkSession, path)

    def save(self, path: str) -> None:
        """Tables as ``write`` makes them."""
        write(self.packed, path)


def write(rows: DataFrame, path: str) -> None:
    """Tables of ``packed`` rows, which may have further columns: documents with their counts, terms and totals. A document is
    one row and stays where it is read: nothing is shuffled but sums by term, and a common term is spread over all files."""
    spark = rows.sparkSession
    with small_batches(spark):
        rows.write.mode("overwrite").parquet(f"{path}/documents")
    stored = spark.read.parquet(f"{path}/documents")
    unique = (F.countDistinct("doc") == F.count("*")).alias("unique")
    totals = stored.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), unique)
    totals.withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(f"{path}/totals")
    weighted(frequencies(stored), spark.read.parquet(f"{path}/totals")).write.mode("overwrite").parquet(f"{path}/terms")


def load(spark, path: str, expected_docs: int | None = None) -> Index:
    """A saved index; raises if its version or number of documents is not the expected one."""
    totals = spark.read.parquet(f"{path}/totals")
    row = totals.first()
    if row is None or row["version"] != VERSION:
        raise ValueError("unknown index version")
    if expected_docs is not None and row["n_docs"] != expected_docs:
        raise ValueError(f"the index holds {row['n_docs']} documents, not {expected_docs}")
    stored = spark.read.parquet(f"{path}/documents")
    return Index(unpacked(stored).select("term", "doc", "tf", "dl"), spark.read.parquet(f"{path}/terms"), totals.select("n_docs", "avgdl"), stored, row["unique"])


#: What makes other rows of ``packed`` ones, in the task that counts them, and the columns that it adds.
Arranged = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def packed(docs: DataFrame, doc: str = "doc_id", text: str = "text", arranged: Arranged | None = None) -> DataFrame:
    """(doc, dl, words, tfs): a document's length, its different words, joined by blanks, and how often each stands there.
    Spark's functions of arrays are interpreted token by token, so words are counted in Arrow batches; joined, they cross
    between Spark and Python as one value. Rows may be arranged before they leave Python."""
    rows = docs.select(F.col(doc).alias("doc"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    then, columns = arranged or (iter, "")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                words, tfs, ends, lengths = [], [], [0], []
                for x in part.column(1):
                    counts = Counter(_words(x.as_py()))
                    words.append(" ".join(counts))
                    tfs += counts.values()
                    ends.append(len(tfs))
                    lengths.append(counts.total())
                times = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int32()), pa.array(words, pa.string()), times], ["doc", "dl", "words", "tfs"])

    made = ", ".join(x for x in ("dl int, words string, tfs array<int>", columns) if x)
    return rows.mapInArrow(lambda batches: then(run(batches)), T.StructType([rows.schema["doc"], *T._parse_datatype_string(made)]))


def unpacked(rows: DataFrame) -> DataFrame:
    """rows with term and tf instead of ``words`` and ``tfs``. Inlined with an empty row for none: else Spark would test every
    array for being empty before it is made, by an expression that makes it anew for each of its tokens."""
    rest = [c for c in rows.columns if c not in ("words", "tfs")]
    each = F.arrays_zip(F.split("words", " ").alias("term"), F.col("tfs").cast("array<long>").alias("tf"))
    return rows.select(*rest, F.inline_outer(each)).where("tf is not null")


def frequencies(rows: DataFrame) -> DataFrame:
    """(term, df) of ``packed`` documents: summed in each batch, then by term."""

    def run(batches):
        for batch in batches:
            counted = pc.split_pattern(batch.column(0), " ").flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["term", "df"])

    return rows.where("dl > 0").select("words").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def build(docs: DataFrame, doc: str = "doc_id", text: str = "text", arranged: Arranged | None = None) -> Index:
    """Index of documents; those without a token count towards their number and mean length.

    Postings are made from ``packed`` documents without a shuffle, and document frequencies are summed map-side.
    """
    rows = packed(docs, doc, text, arranged)
    totals = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return Index(unpacked(rows).select("term", "doc", "tf", "dl"), weighted(frequencies(rows), totals), totals, rows)


def weighted(df: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf) of (term, df); a negative weight becomes a quarter of the mean of all."""
    counts = df.join(totals)  # one row on the right
    raw = counts.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def small(rows: DataFrame) -> DataFrame:
    """Saved rows, to be broadcast if they are counted to be few; a join by shuffle gives the same rows."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def asked_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, times): words are counted as those of documents are."""
    each = unpacked(packed(queries, query, text)).select(F.col("doc").alias("query_id"), "term", "tf")
    return each.groupBy("query_id", "term").agg(F.sum("tf").alias("times"))


def weights(index: Index, queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, times, idf) of the queries' terms that the index has."""
    return index.terms.join(small(saved(asked_terms(queries, query, text))), "term").select("query_id", "term", "times", "idf")


def dense(index: Index, weighted: DataFrame, k: int = 1) -> bool:
    """Whether documents can be scored row by row: each is one row, and the weights and ``k`` rows a query are few enough to
    go to all tasks."""
    n = weighted.agg(F.countDistinct("query_id").alias("queries"), F.countDistinct("term").alias("terms"), F.count("*").alias("rows")).first()
    return bool(index.unique) and isinstance(index.packed.schema["doc"].dataType, (T.IntegerType, T.LongType)) and n["queries"] * n["terms"] <= DENSE and max(n["rows"], n["queries"] * k) <= FEW


def search(index: Index, queries: DataFrame, k: int = 20, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, rank from 0, doc, score) of the k best documents of each query; scores above zero only.

    A token that a query repeats counts as often. Of a saved index whose documents lie in one row each, documents are
    scored row by row, and each task hands on its k best of a query (``_best``); else, or where queries are too many for
    that, only postings of the queries' terms go on. These are few as a rule, and go to the postings
    (``small``): then what a document's terms add is summed where its postings lie. Ties go to the smaller document; each
    task keeps a query's k best before the last shuffle.
    """
    weighted = saved(weights(index, queries, query, text))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    if dense(index, weighted):
        scored = _best(index, weighted, k)
    else:
        wanted = small(saved(weighted.select("term").distinct()))
        hits = index.postings.join(wanted, "term", "left_semi").join(small(weighted), "term").join(index.totals.select("avgdl"))
        part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = hits.groupBy("query_id", "doc").agg(F.round(F.sum(part), DIGITS).alias("score")).where("score > 0")
    return scored.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k).select("query_id", (F.col("__n") - 1).alias("rank"), "doc", "score")


@dataclass
class Weights:
    """Weights of terms by queries, as each task holds them."""

    table: np.ndarray  # a row for each term, a column for each query
    known: pa.Array  # terms
    names: pa.Array  # ids of queries
    avgdl: float | None

    def hits(self, dl: np.ndarray, words: pa.Array, tfs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the row, place of the term, its part of a score but for the weight) of the known terms of rows."""
        terms = pc.split_pattern(words, " ")
        at = pc.index_in(terms.flatten(), value_set=self.known)
        hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        tf = tfs.flatten().to_numpy()[hit].astype(float)
        of = np.repeat(np.arange(len(dl)), terms.value_lengths().to_numpy())[hit]
        return of, at.fill_null(0).to_numpy()[hit], tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[of] / self.avgdl)) if len(hit) else tf

    def scores(self, of: np.ndarray, at: np.ndarray, part: np.ndarray, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their scores by query) of ``hits``, some rows at a time; of the queries ``only``, if given."""
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        step, i = max(1, CELLS // max(1, self.table.shape[1] if only is None else len(only))), 0
        while i < len(starts):  # rows whose hits are ``step`` at most, or a single one
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + step, "right")) - 1)
            j = len(starts) if len(of) - starts[i] <= step else j
            a, b = starts[i], starts[j] if j < len(starts) else len(of)
            taken = self.table[at[a:b]] if only is None else self.table[np.ix_(at[a:b], only)]
            sums = np.add.reduceat(taken * part[a:b, None], starts[i:j] - a, axis=0)
            yield of[starts[i:j]], np.floor(sums * 10**DIGITS + 0.5) / 10**DIGITS
            i = j


class Best:
    """The k best documents of each of n queries among those that are added; ties to the smaller document. ``least``: what a
    document must have to be among them, as far as is known."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.least = k, np.zeros(n) if least is None else least.copy()
        self.kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> None:
        self.more.append((queries, scores, docs))
        self.waiting += len(queries)
        if self.waiting > 1 << 16:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, scores, documents) so far."""
        q, s, d = (np.concatenate(x) for x in zip(self.kept, *self.more))
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = s[last]
        self.kept, self.waiting = tuple(x[place < self.k] for x in (q, s, d)), 0
        self.more.clear()
        return self.kept


def table(index: Index, weighted: DataFrame) -> Weights:
    """``weights`` for the tasks; they are few (``dense``)."""
    asked = weighted.select("query_id", "term", (F.col("times") * F.col("idf")).alias("w")).toArrow().combine_chunks()
    ids, words = (pc.dictionary_encode(asked[c], null_encoding="encode").combine_chunks() for c in ("query_id", "term"))
    ids, words = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, words))
    cells = np.zeros((len(words.dictionary), len(ids.dictionary)))
    cells[words.indices.to_numpy(), ids.indices.to_numpy()] = asked["w"].to_numpy()
    return Weights(cells, words.dictionary, ids.dictionary, index.totals.first()["avgdl"])


def _best(index: Index, weighted: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, score) of the k best documents that each task finds for each query.

    ``weighted`` is small (``dense``) and goes to all tasks as a table of terms by queries. A document's counts
    are one row, so its scores are sums of rows of that table and no hit leaves its task.
    """
    rows = index.packed.where("dl > 0").select("doc", "dl", "words", "tfs")
    return rows.mapInArrow(scorer(table(index, weighted), k), scored_as(weighted, rows))


def scored_as(weighted: DataFrame, rows: DataFrame) -> T.StructType:
    return T.StructType([weighted.schema["query_id"], rows.schema["doc"], T.StructField("score", T.DoubleType())])


def sliced(batches: Iterator[pa.RecordBatch], most: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of ``most`` rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def scorer(weights: Weights, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores rows (doc, dl, words, tfs); the k best of each query."""

    def run(batches):
        best, kind = Best(weights.table.shape[1], k), None
        for batch in sliced(batches):
            kind = batch.schema.field(0).type
            docs = batch.column(0).to_numpy()
            for rows, scores in weights.scores(*weights.hits(batch.column(1).to_numpy(), batch.column(2), batch.column(3))):
                x, y = np.nonzero((scores > 0) & (scores >= best.least))
                best.add(y, scores[x, y], docs[rows[x]].astype(np.int64))
        yield from handed(best, weights.names, kind)

    return run


def handed(best: Best, names: pa.Array, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
    """What a task has found (query_id, doc, score), if it has."""
    q, s, d = best.settle()
    pa.default_memory_pool().release_unused()
    if len(q):
        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(d).cast(kind), pa.array(s)], ["query_id", "doc", "score"])
