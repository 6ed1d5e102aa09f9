"""BM25 with pruned postings: blocks of documents, the most that a term may give in a block, and two passes.

Documents lie in blocks of about ``BLOCK`` documents of like length (scores depend on it). A block's first row also holds the
words of the whole block and the largest count of each: read as a document of the block's least length, it scores what a
document of the block can reach at most. The first pass scores the most promising blocks and so learns what the k-th best
document has at least; the second scores only blocks whose bound reaches that. Rows are those of ``lexical.search``: bounds
are never too low, and ties at the threshold are scored.

Scaling. Blocks are made where documents are read, of the rows that come together, and the tables are those of a lexical index
with three more columns: nothing is shuffled but sums by term, and a collection keeps one copy of its counts for both searches.
A search reads the blocks' words, then all rows in their order; only the best of each task leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved, small_batches
from . import lexical

#: Documents of a block at most, and blocks whose words are put together at once.
BLOCK, TOGETHER = 16, 64
#: Rows that are cut into blocks together, about, and their bytes.
GATHER, HELD = 4096, 8 << 20
#: Scores are rounded to ``lexical.DIGITS``: what a bound may be short of a rounded threshold.
SLACK = 2.0 * 10.0**-lexical.DIGITS
#: Columns beside those of ``lexical.packed``: a block's number (null: no words), and in its first row all words and their largest counts.
COLUMNS = "block long, heads string, most array<int>"


@dataclass
class Blocks:
    index: lexical.Index  # ``packed`` has ``COLUMNS`` too


def dealer(block: int = BLOCK) -> Callable:
    """Gives ``lexical.packed`` batches ``COLUMNS``. Rows that come together are ordered by length and cut into blocks."""

    def heads(part: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
        """Words and their largest counts of each block of the rows."""
        terms = pc.split_pattern(part.column(2), " ")
        coded = terms.flatten().dictionary_encode()
        n = len(coded.dictionary)
        key = np.repeat(np.arange(part.num_rows) // block, terms.value_lengths().to_numpy()) * n + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        most = np.maximum.reduceat(part.column(3).flatten().to_numpy()[order], starts)
        ends = pa.array(np.searchsorted(key[starts] // n, np.arange(-(-part.num_rows // block) + 1)), pa.int32())
        words = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key[starts] % n)))
        return pc.binary_join(words, " "), pa.ListArray.from_arrays(ends, pa.array(most, pa.int32()))

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in gathered(batches):
            dl = batch.column(1).to_numpy()
            order = np.argsort(dl, kind="stable")
            none, at = int((dl == 0).sum()), 0
            while at < batch.num_rows:
                end = none if at < none else min(batch.num_rows, at + block * TOGETHER)
                part = batch.take(pa.array(order[at:end]))
                n, at = part.num_rows, end
                if end <= none:
                    more = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32()))]
                else:
                    words, most = heads(part)
                    place = pa.array(np.arange(n) // block, mask=np.arange(n) % block > 0)
                    more = [pa.array(number + np.arange(n) // block), words.take(place), most.take(place)]
                    number += -(-n // block)
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "block", "heads", "most"])

    return run


def gathered(batches) -> Iterator[pa.RecordBatch]:
    """Batches of some thousand rows, fewer of long ones."""
    parts, n, held = [], 0, 0
    for batch in lexical.sliced(batches):
        parts.append(batch)
        n, held = n + batch.num_rows, held + batch.nbytes
        if n >= GATHER or held >= HELD:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
            parts, n, held = [], 0, 0
    if n:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def save(docs: DataFrame, path: str, block: int = BLOCK, doc: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> None:
    """Writes the tables that ``load`` and ``lexical.load`` read, of documents as ``lexical.build`` takes them, and of ``known``
    ones that are ``packed`` already."""
    rows = lexical.build(docs, doc, text, (dealer(block), COLUMNS)).packed
    if known is not None:
        rows = known.select("doc", "dl", "words", "tfs").mapInArrow(dealer(block), rows.schema).unionByName(rows)
    lexical.write(rows, path)


def load(spark: SparkSession, path: str, expected_docs: int | None = None) -> Blocks:
    """Saved blocks; raises as ``lexical.load`` does, and if the index has none."""
    index = lexical.load(spark, path, expected_docs)
    if "heads" not in index.packed.columns:
        raise ValueError("an index without blocks")
    return Blocks(index)


@dataclass
class Search:
    """A search whose blocks are chosen: ``found`` are the rows of ``lexical.search``."""

    found: DataFrame
    chosen: DataFrame  # query_id, block of the blocks that are scored
    weighted: DataFrame  # query_id, term, times, idf
    blocks: Blocks

    def read(self) -> DataFrame:
        """(scored, postings): postings that were scored for all queries, and those that all their terms have."""
        each = lexical.unpacked(self.blocks.index.packed.where("dl > 0").select("block", "words", "tfs"))
        of = each.join(lexical.small(self.weighted), "term").groupBy("query_id", "block").agg(F.count("*").alias("n"))
        hit = self.chosen.distinct().withColumn("hit", F.lit(True))
        return of.join(hit, ["query_id", "block"], "left").agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("scored"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))


def _reaching(bounds: lexical.Weights, least: np.ndarray) -> Callable:
    """(query_id, doc) of blocks, read as documents, whose bound reaches what a query's best have at least."""

    def run(batches):
        for batch in lexical.sliced(batches):
            ids = batch.column(0).to_numpy()
            for rows, reach in bounds.scores(*bounds.hits(batch.column(1).to_numpy(), batch.column(2), batch.column(3))):
                x, y = np.nonzero((reach > 0) & (reach >= least - SLACK))
                yield pa.RecordBatch.from_arrays([bounds.names.take(pa.array(y)), pa.array(ids[rows[x]])], ["query_id", "block"])

    return run


def _scorer(weights: lexical.Weights, bounds: lexical.Weights, k: int, least: np.ndarray, pairs: dict[int, np.ndarray] | None = None) -> Callable:
    """Scores documents (doc, dl, words, tfs, block, heads, most) in order of their blocks; the k best of each query.

    A block is scored for the queries that ``pairs`` names, or without these for all whose ``least`` its bound reaches. Rows
    whose block begins in another task have no bound here and are scored for all queries.
    """

    def run(batches):
        n = weights.table.shape[1]
        best, kind, block, wanted = lexical.Best(n, k, least), None, None, np.ones(n, bool)
        for batch in lexical.sliced(batches):
            kind = batch.schema.field(0).type
            ids, docs, dl = batch.column(4).to_numpy(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
            ends = np.r_[starts[1:], len(ids)]
            reached = np.zeros((len(starts), n), bool)
            first = batch.column(5).is_valid().to_numpy(zero_copy_only=False)[starts]
            if pairs is not None:
                for i, b in enumerate(ids[starts]):
                    reached[i, pairs.get(int(b), ())] = True
            else:
                rows = pa.array(starts[first])
                for x, reach in bounds.scores(*bounds.hits(dl[starts[first]], batch.column(5).take(rows), batch.column(6).take(rows))):
                    reached[np.flatnonzero(first)[x]] = (reach > 0) & (reach >= best.least - SLACK)
                for i in np.flatnonzero(~first):  # at most the first: it goes on, or began elsewhere
                    reached[i] = wanted if ids[starts[i]] == block else True
            block, wanted = ids[-1], reached[-1]
            of, hit, part = weights.hits(dl, batch.column(2), batch.column(3))
            lows, highs = np.searchsorted(of, starts), np.searchsorted(of, ends)
            for i in np.flatnonzero(reached.any(1) & (highs > lows)):
                a, b = lows[i], highs[i]
                only = None if reached[i].all() else np.flatnonzero(reached[i])
                floor = best.least if only is None else best.least[only]
                for rows, scores in weights.scores(of[a:b], hit[a:b], part[a:b], only):
                    x, y = np.nonzero((scores > 0) & (scores >= floor))
                    if len(x):
                        best.add(y if only is None else only[y], scores[x, y], docs[rows[x]].astype(np.int64))
        yield from lexical.handed(best, weights.names, kind)

    return run


def search(blocks: Blocks, queries: DataFrame, k: int = 20, query: str = "query_id", text: str = "text") -> Search:
    """The k best documents of each query, as ``lexical.search`` has them: (query_id, rank from 0, doc, score). Where that
    cannot score documents row by row (``lexical.dense``), all blocks are scored, and rows are made by its joins."""
    index = blocks.index
    weighted = saved(lexical.weights(index, queries, query, text))
    rows = index.packed.where("dl > 0").select("doc", "dl", "words", "tfs", "block", "heads", "most")
    tops = rows.where("heads is not null").select(F.col("block").alias("doc"), "dl", F.col("heads").alias("words"), F.col("most").alias("tfs"))
    if not lexical.dense(index, weighted, k):
        every = weighted.select("query_id").distinct().crossJoin(tops.select(F.col("doc").alias("block")))
        return Search(lexical.search(index, queries, k, query, text), every, weighted, blocks)
    weights = lexical.table(index, weighted)
    bounds = lexical.Weights(np.maximum(weights.table, 0), weights.known, weights.names, weights.avgdl)
    places = {q: i for i, q in enumerate(weights.names.to_pylist())}

    def best(scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
        return scored.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)

    with small_batches(rows.sparkSession):
        # k blocks of each query at most, and their k-th scores
        promising = best(tops.mapInArrow(lexical.scorer(bounds, k), lexical.scored_as(weighted, tops))).select("query_id", F.col("doc").alias("block")).collect()
        pairs: dict[int, list[int]] = {}
        for r in promising:
            pairs.setdefault(r["block"], []).append(places[r["query_id"]])
        first = rows.sparkSession.createDataFrame(promising, T.StructType([weighted.schema["query_id"], T.StructField("block", T.LongType())]))
        named = {b: np.array(q) for b, q in pairs.items()}
        schema, least = lexical.scored_as(weighted, rows), np.zeros(len(places))
        some = rows.join(F.broadcast(first.select("block").distinct()), "block", "left_semi").select(*rows.columns)
        for r in best(some.mapInArrow(_scorer(weights, bounds, k, least, named), schema)).where(F.col("__n") == k).collect():
            least[places[r["query_id"]]] = r["score"]
        chosen = tops.mapInArrow(_reaching(bounds, least), T.StructType([weighted.schema["query_id"], T.StructField("block", T.LongType())]))
        found = saved(best(rows.mapInArrow(_scorer(weights, bounds, k, least), schema)).select("query_id", (F.col("__n") - 1).alias("rank"), "doc", "score"))
    return Search(found, chosen.unionByName(first), weighted, blocks)
