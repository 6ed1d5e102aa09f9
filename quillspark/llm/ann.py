"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are reduced so that the largest inner product is the smallest Euclidean distance (one more component
that fills each vector up to the largest norm), projected on Gaussian directions and cut into cells. A query
visits its own cell and perturbed ones in order of estimated success, the sum of squared distances to the
cell walls that are crossed; candidates of all tables are merged and reranked on the original vectors.

Scaling. Equal vectors are indexed once, with their smallest ids (more can never be among the nearest), so a
group of copies costs one candidate. Each vector goes once for each table to the bucket of its cell; a query goes
to the buckets of the cells it visits, so the work follows visits, not queries times vectors. Buckets join cells
that agree in their first coordinates, since perturbed cells mostly do. A bucket that holds too many vectors (a hot
cell) is salted by vector, one that is asked too often by query. Inside a bucket only vectors of visited cells are
scored, on the original vectors; a bucket returns k rows a query at most, and the tables' results are merged.

Cell width and number of probes are fitted to a wanted recall on a bounded sample, by the same rule at every size; the
widest cells reach it on any data, at the cost of visiting most vectors. Only for queries that find fewer than k vectors
are all vectors scored, in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

#: Tables, directions of a table, cell widths to choose from (vectors are scaled into the unit ball) and seed.
TABLES, DIRECTIONS, WIDTHS, SEED = 4, 6, (0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 6.0, 12.0), 5
#: Coordinates of a cell that choose its bucket.
COARSE = 2
#: Bound of the sample that the number of probes is fitted on, its queries, and the recall wanted there.
SAMPLE_VECTORS, SAMPLE_QUERIES, WANTED = 8192, 128, 0.93
BLOCK_VECTORS, BLOCK_QUERIES, LEAST_QUERY_BLOCKS = 50_000, 20_000, 4


@dataclass
class Index:
    dim: int
    largest: float
    directions: np.ndarray  # dim + 1 by tables * per table
    shifts: np.ndarray
    per_table: int
    width: float
    probes: int
    reached: bool = True  # the wanted recall, on the sample
    share: float = 1.0  # of the sample's vectors that a query visits

    def projected(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions + self.shifts) / self.width

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / self.largest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates of each vector's cell in each table."""
        return np.floor(self.projected(self.lifted(vectors))).astype(np.int64).reshape(len(vectors), -1, self.per_table)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Cell number of each vector in each table."""
        return self._numbered(self.places(vectors))

    def buckets(self, at: np.ndarray, n: int) -> np.ndarray:
        """Bucket of cells at coordinates (vector or query, table, ..., coordinate), of n in each table."""
        coarse = at[..., 0].astype(np.uint64)
        for i in range(1, min(COARSE, self.per_table)):
            coarse = coarse * np.uint64(1_000_003) + at[..., i].astype(np.uint64)
        mixed = (coarse * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        tables = np.arange(at.shape[1]).reshape((1, -1) + (1,) * (at.ndim - 3))
        return tables * n + (mixed % np.uint64(n)).astype(np.int64)

    def _numbered(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(at.shape[:-1], np.int64)
        for i in range(self.per_table):
            out = out * np.int64(1_000_003) + at[..., i]
        return out

    def visited(self, queries: np.ndarray) -> np.ndarray:
        """Cells (query, table, probe) in estimated order of success."""
        return self._numbered(self.visits(queries))

    def visits(self, queries: np.ndarray) -> np.ndarray:
        """Coordinates of the visited cells (query, table, probe, coordinate) in estimated order of success."""
        n = min(self.probes, 3**self.per_table)
        x = queries / np.abs(queries).max(1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        place = self.projected(np.concatenate([x, np.zeros((len(x), 1))], 1)).reshape(len(x), -1, self.per_table)
        floor = np.floor(place)
        moves = np.array(list(itertools.product((0, -1, 1), repeat=self.per_table)), np.int64)
        down, up = (moves == -1).T.astype(np.float64), (moves == 1).T.astype(np.float64)
        cost = ((place - floor) ** 2) @ down + ((floor + 1 - place) ** 2) @ up
        best = np.argsort(cost, axis=-1, kind="stable")[..., :n]
        return floor.astype(np.int64)[:, :, None, :] + moves[best]


class Tables:
    """Vectors by their cells in every table, or in the given ones."""

    def __init__(self, index: Index, vectors: np.ndarray, tables: slice = slice(None)):
        self.index, self.n = index, len(vectors)
        cells = index.cells(vectors)[:, tables]
        orders = [np.argsort(c, kind="stable") for c in cells.T]
        self.tables = [(o, c[o]) for o, c in zip(orders, cells.T)]

    def candidates(self, visits: np.ndarray) -> np.ndarray:
        """Positions of the vectors in the visited cells (table by probe), each once."""
        seen = np.zeros(self.n, bool)
        for (order, cells), visit in zip(self.tables, visits):
            lo = np.searchsorted(cells, visit, "left")
            size = np.searchsorted(cells, visit, "right") - lo
            lo, size = lo[size > 0], size[size > 0]
            seen[order[np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)]] = True
        return np.flatnonzero(seen)


def best_of(vectors: np.ndarray, ids: np.ndarray, found: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the found positions, and their scores; ties by id."""
    rough = vectors[found] @ q
    if len(found) > k:
        floor = np.partition(rough, -k)[-k]
        found = found[rough >= floor - 1e-9 * max(1.0, abs(floor))]
    score = (vectors[found] * q).sum(1)
    best = np.lexsort((ids[found], -score))[:k]
    return found[best], score[best]


def nearest(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
    """For each query: positions and scores of its k best vectors, all of them scored."""
    for q in queries:
        yield best_of(vectors, ids, np.arange(len(vectors)), q, k)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, v) with a non-null id and a vector of the usual length without null, NaN or infinite
    components that is not zero."""
    v = F.col(vec_col).cast("array<double>")
    largest = F.array_max(F.transform(v, F.abs))
    # relative to the largest component, so that no square leaves the range of doubles
    norm = largest * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest)))
    fine = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), norm.alias("norm"), largest.alias("m"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return fine.where(F.col("id").isNotNull() & sound & (F.col("m") > 0)).drop("m")


def first_visits(index: Index, vectors: np.ndarray, queries: np.ndarray) -> Iterator[np.ndarray]:
    """For each query, the number of the probe that first visits each vector's cell in any table, counted from 0."""
    cells, visits = index.cells(vectors), index.visited(queries)
    known = [np.unique(c, return_inverse=True) for c in cells.T]
    for visit in visits:
        out = np.full(len(vectors), visits.shape[2], np.int64)
        for (names, which), order in zip(known, visit):
            first = np.full(len(names), visits.shape[2], np.int64)
            at = np.minimum(np.searchsorted(names, order), len(names) - 1)
            hit = np.flatnonzero(names[at] == order)[::-1]  # the earliest probe is put last, and stays
            first[at[hit]] = hit
            np.minimum(out, first[which], out)
        yield out


def fitted(vectors: np.ndarray, ids: np.ndarray, dim: int, largest: float, k: int, tables: int = TABLES, directions: int = DIRECTIONS, widths: tuple[float, ...] = WIDTHS, wanted: float = WANTED, seed: int = SEED) -> Index:
    """Of the cell widths and numbers of probes that reach the wanted recall on these vectors, those that visit the fewest.

    The widest cells let every probe of the first ring reach all vectors, so some setting always reaches it; ``share`` is
    what it visits."""
    rng = np.random.default_rng(seed)
    normal, uniform = rng.normal(size=(dim + 1, tables * directions)), rng.uniform(0, 1, tables * directions)
    most = 3**directions
    best = (False, -1.0, widths[-1], most)
    queries = vectors[:: max(1, len(vectors) // SAMPLE_QUERIES)]
    truth = [found for found, _ in nearest(vectors, ids, queries, k)]
    for width in widths if len(vectors) else ():
        index = Index(dim, largest, normal, uniform * width, directions, width, most)
        share, recall = np.zeros(most), np.zeros(most)
        for first, near in zip(first_visits(index, vectors, queries), truth):
            share += np.cumsum(np.bincount(first, minlength=most + 1)[:most]) / len(vectors)
            recall += np.cumsum(np.bincount(first[near], minlength=most + 1)[:most]) / len(near)
        share, recall = share / len(queries), recall / len(queries)
        enough = np.flatnonzero(recall >= wanted)
        at = enough[0] if len(enough) else most - 1
        best = max(best, (bool(len(enough)), -share[at] if len(enough) else recall[at], width, int(at) + 1))
    reached, value, width, probes = best
    return Index(dim, largest, normal, uniform * width, directions, width, probes, reached, float(-value) if reached else 1.0)


def fit(distinct: DataFrame, dim: int, largest: float, n: int, k: int, **settings) -> Index:
    """``fitted`` on a sample of at most ``SAMPLE_VECTORS`` vectors: those with the smallest hashes of their ids."""
    unit = F.xxhash64("vid") / F.lit(2.0**64) + 0.5
    drawn = distinct.where(unit < min(1.0, 2 * SAMPLE_VECTORS / max(1, n)))  # twice as many as are taken
    rows = drawn.select("vid", "v").orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE_VECTORS).toPandas().sort_values("vid")
    vectors = np.stack(rows["v"]) if len(rows) else np.zeros((0, dim))
    return fitted(vectors, rows["vid"].to_numpy(), dim, largest, k, **settings)


FOUND = "qid long, vid long, score double"


def _found(parts: list[tuple]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({"qid": pd.Series(dtype="int64"), "vid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return pd.DataFrame(dict(zip(("qid", "vid", "score"), map(np.concatenate, zip(*parts)))))


def _dealt(rows: DataFrame, index: Index, n: int, asked: bool) -> DataFrame:
    """(b, id, v): vectors (id, v) once for each table, in their bucket; queries once for each bucket they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for at in range(0, table.num_rows, 512):
                part = table.slice(at, 512)
                ids = part.column(0).to_numpy()
                v = np.array(part.column(1).to_pylist(), np.float64)
                if asked:
                    found = index.buckets(index.visits(v), n).reshape(len(v), -1)
                    found.sort(axis=1)
                    first = np.concatenate([np.ones((len(v), 1), bool), found[:, 1:] != found[:, :-1]], 1)
                    row, bucket = np.nonzero(first)[0], found[first]
                else:
                    found = index.buckets(index.places(v), n)
                    row, bucket = np.repeat(np.arange(len(v)), found.shape[1]), found.ravel()
                for i in range(0, len(row), 20_000):
                    r = row[i : i + 20_000]
                    flat = pa.array(v[r].ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * v.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[i : i + 20_000]), pa.array(ids[r]), lists], names=["b", "id", "v"])

    return rows.mapInArrow(run, "b long, id long, v array<double>")


def _by_cells(distinct: DataFrame, queries: DataFrame, index: Index, n_vectors: int, k: int) -> DataFrame:
    """The k best of each query in each bucket it visits."""
    n = max(1, -(-n_vectors // BLOCK_VECTORS))
    left, right = _dealt(distinct.select("vid", "v"), index, n, False), _dealt(queries.select("qid", "v"), index, n, True)
    sizes = left.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_VECTORS).alias("vs")).join(right.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("qs")), "b")
    sizes = saved(sizes)
    salt = lambda by: F.pmod(F.xxhash64("id"), F.col(by))
    each = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))
    left = left.join(sizes, "b").select("b", salt("vs").alias("i"), each("qs").alias("j"), "id", "v")
    right = right.join(sizes, "b").select("b", each("vs").alias("i"), salt("qs").alias("j"), "id", "v")

    def search(key: tuple, vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple] = []
        if len(vectors) and len(asked):
            ids, qids, space = vectors["id"].to_numpy(), asked["id"].to_numpy(), np.stack(vectors["v"])
            one = slice(int(key[0]) // n, int(key[0]) // n + 1)  # a bucket belongs to one table
            tables = Tables(index, space, one)
            for at in range(0, len(qids), 128):
                q = np.stack(asked["v"][at : at + 128])
                for i, x, visit in zip(qids[at : at + 128], q, index.visited(q)[:, one]):
                    found, score = best_of(space, ids, tables.candidates(visit), x, k)
                    parts.append((np.full(len(found), i), ids[found], score))
        return _found(parts)

    return left.groupBy("b", "i", "j").cogroup(right.groupBy("b", "i", "j")).applyInPandas(search, FOUND).dropDuplicates(["qid", "vid"])


def _exhaustive(distinct: DataFrame, queries: DataFrame, n_vectors: int, n_queries: int, k: int) -> DataFrame:
    """The k best of each query in each block of vectors: all pairs, for the few queries that hashing fails."""
    vb = max(1, -(-n_vectors // BLOCK_VECTORS))
    qb = max(LEAST_QUERY_BLOCKS, -(-n_queries // BLOCK_QUERIES))
    left = distinct.select("vid", "v", F.pmod(F.xxhash64("vid"), F.lit(vb)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("j"))
    right = queries.select("qid", "v", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))).alias("i"), F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int").alias("j"))

    def search(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return _found([])
        ids, space = vectors["vid"].to_numpy(), np.stack(vectors["v"])
        return _found([(np.full(len(found), q), ids[found], score) for q, (found, score) in zip(asked["qid"], nearest(space, ids, np.stack(asked["v"]), k))])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(search, FOUND)


def search(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``asked`` picks, by inner product.

    ``asked`` is a condition on the column ``id``. A row is never its own neighbour; ties go to the smaller id;
    fewer than k other vectors: all of them. Null ids, and vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part. Repeated rows count once. Other columns are
    ignored; no usable vector: no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    fine = usable(vectors, id_col, vec_col)
    facts = fine.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("largest")).orderBy(F.desc("n"), "dim").first()
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.where(F.size("v") == facts["dim"]).select("id", "v").distinct()
    by_vector = Window.partitionBy("v").orderBy("id")
    few = fine.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    distinct = saved(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0]))
    rows = fine.where(asked).join(distinct.select("v", "vid"), "v").select(F.col("id").alias("query_id"), "vid")
    rows = saved(rows)
    queries = saved(rows.select(F.col("vid").alias("qid")).distinct().join(distinct.select(F.col("vid").alias("qid"), "v"), "qid"))
    n_vectors = distinct.count()
    index = index or fit(distinct, facts["dim"], facts["largest"], n_vectors, k)

    def best(found: DataFrame) -> DataFrame:
        ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
        return found.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).drop("r")

    found = saved(best(_by_cells(distinct, queries, index, n_vectors, k + 1)))
    full = found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, n_vectors))
    short = saved(queries.join(full, "qid", "left_anti"))
    if not short.isEmpty():
        again = best(_exhaustive(distinct, short, n_vectors, short.count(), k + 1))
        found = found.join(short.select("qid"), "qid", "left_anti").unionByName(again)
    copies = found.join(distinct.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    top = copies.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    each = rows.join(top, rows["vid"] == top["qid"]).where("vec_id <> query_id")
    # a query's own row is among its first k + 1, or all of those are others
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "vid").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
