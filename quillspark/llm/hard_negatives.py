"""Hard-negative mining with a vector-approximation file.

Vectors are scaled to whole numbers and stored beside an approximation: the number of the cell that each component
lies in, a byte a dimension. For an anchor, two tables (dimension by cell) hold the least and the largest product of
its component with a cell's; sums of looked-up entries bound the score of every row from below and above. A row is
scored exactly only if its bounds let it enter one of the anchor's windows: first the window of its best positives,
then, for each positive, that of the negatives that may stand beside it.

Scaling. Rows and anchors meet in blocks: each block of rows is dealt once for each block of anchors, by a hash of the
id, so no label and no group of copies is a task of its own. A meeting returns at most as many rows as are wanted of
each anchor or window, and the blocks' results are ranked by anchor. Cell limits are the least and largest component
that occurs in the cell, over all rows; only where cells are cut is read off a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

#: Cells of a dimension, and the bound of the sample that they are cut on.
CELLS, SAMPLE_ROWS = 64, 8192
#: Components (rows times dimensions) of a block of rows, anchors of a block, and anchors' blocks at least.
BLOCK_COMPONENTS, BLOCK_ANCHORS, LEAST_ANCHOR_BLOCKS = 1 << 20, 1000, 4
#: Components of unpacked rows at once; rows of a tile, and anchors that are looked up together.
STEP, TILE, TOGETHER = 1 << 20, 1024, 32


@dataclass
class Grid:
    """Cells of each dimension: cuts (dim, CELLS - 1), and the least and largest component in each (dim, CELLS)."""

    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def codes(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.searchsorted(cuts, rows[:, j], "right")
        return out


class Approximations:
    """Rows of a block by their codes: bounds of their scores with anchors. Rows are kept in tiles, so that what is looked
    up stays in a core's cache."""

    def __init__(self, grid: Grid, codes: np.ndarray):
        self.grid, self.n = grid, len(codes)
        places = codes.T.astype(np.intp) + np.arange(codes.shape[1])[:, None] * CELLS  # dimension by row
        self.tiles = [(i, np.ascontiguousarray(places[:, i : i + TILE])) for i in range(0, self.n, TILE)]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of every row with each anchor (anchor by row), by table lookup."""
        low, high = (np.empty((len(anchors), self.n), np.int64) for _ in range(2))
        a, b = anchors[:, :, None] * self.grid.low, anchors[:, :, None] * self.grid.high
        tables = [(np.minimum(a, b).reshape(len(anchors), -1), low), (np.maximum(a, b).reshape(len(anchors), -1), high)]
        for at, places in self.tiles:
            for table, out in tables:
                for one, sums in zip(table, out):
                    one.take(places).sum(0, out=sums[at : at + places.shape[1]])
        return low, high


def kth_largest(values: np.ndarray, k: int):
    """The k-th largest value, None of fewer."""
    return np.partition(values, -k)[-k] if len(values) >= k else None


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first: larger scores, then smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where no sum leaves their whole range, else as integers."""
    if len(rows) and float(np.abs(rows).max()) * float(np.abs(anchor).max()) * rows.shape[1] < 2.0**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return (rows * anchor).sum(1)


def best_positives(rows: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of the k best rows and their scores, and how many were scored."""
    least = kth_largest(low, k)
    may = np.arange(len(rows)) if least is None else np.flatnonzero(high >= least)
    score = products(rows[may], anchor)
    best = first(ids[may], score, k)
    return may[best], score[best], len(may)


def window_negatives(rows: np.ndarray, ids: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window the k first of the rows ``far`` inside (positions, scores), and how many were scored."""
    may = np.zeros(len(rows), bool)
    for least, most in windows:
        possible = (high >= least) & (low <= most) & far
        surely = kth_largest(low[possible & (low >= least) & (high <= most)], k)
        may |= possible if surely is None else possible & (high >= surely)
    at = np.flatnonzero(may)
    score = products(rows[at], anchor)
    out = []
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        best = inside[first(ids[at[inside]], score[inside], k)]
        out.append((at[best], score[best]))
    return out, len(at)


def usable(rows: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, v): one row for each id, vectors as whole numbers floor(scale * x).

    Left out: null ids and labels, null vectors, those with null or non-finite components, those of another length than
    most, and those with a component so large that a score could leave the range of a long. Of rows with one id that
    of the least label and vector stays.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    fine = fine.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound & (F.size("v") > 0))
    # before anything is cast: no hundredfold score of such components leaves a long
    small = F.forall("v", lambda x: F.abs(x * scale) < F.sqrt(F.lit(2.0**55) / F.size("v")))
    return fine.where(small).withColumn("v", F.transform("v", lambda x: F.floor(x * scale))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def grid_of(rows: DataFrame, dim: int, n: int) -> Grid:
    """Cells cut at quantiles of a sample of at most ``SAMPLE_ROWS`` rows, the first by a hash of their ids; their limits
    are those of all rows, summed up by cell in the tasks."""
    sample = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    values = np.stack(sample["v"])
    cuts = np.quantile(values, np.arange(1, CELLS) / CELLS, axis=0, method="higher").T.astype(np.int64)
    grid = Grid(cuts, np.zeros((dim, CELLS), np.int64), np.zeros((dim, CELLS), np.int64))

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((dim, CELLS), np.iinfo(np.int64).max), np.full((dim, CELLS), np.iinfo(np.int64).min)
        at = np.arange(dim) * CELLS
        for batch in batches:
            for i in range(0, batch.num_rows, max(1, STEP // dim)):
                v = unpacked(batch.column(0).slice(i, max(1, STEP // dim)), dim)
                cell = (grid.codes(v) + at).ravel()
                np.minimum.at(low.ravel(), cell, v.ravel())
                np.maximum.at(high.ravel(), cell, v.ravel())
        cell = np.flatnonzero(low.ravel() <= high.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(low.ravel()[cell]), pa.array(high.ravel()[cell])], names=["cell", "low", "high"])

    # one row for each dimension and cell reaches the driver
    for r in rows.select("v").mapInArrow(limits, "cell long, low long, high long").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        grid.low.ravel()[r["cell"]], grid.high.ravel()[r["cell"]] = r["low"], r["high"]
    return grid


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def coded(rows: DataFrame, grid: Grid, dim: int) -> DataFrame:
    """The approximation file: rows with ``code``, a byte a dimension."""

    @F.arrow_udf("binary")
    def code(v: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in grid.codes(unpacked(v, dim))], pa.binary())

    return rows.withColumn("code", code("v"))


def _bounded(anchors: pd.DataFrame, known: Approximations) -> Iterator[tuple]:
    """Each anchor with its vector and the bounds of all rows."""
    for i in range(0, len(anchors), TOGETHER):
        some = anchors.iloc[i : i + TOGETHER]
        vectors = np.stack(some["v"]).astype(np.int64)
        yield from zip(some.itertuples(index=False), vectors, *known.bounds(vectors))


FOUND = "anchor_id long, positive_id long, vec_id long, score long"


def _found(parts: list[tuple]) -> pd.DataFrame:
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("anchor_id", "positive_id", "vec_id", "score"), cols)))


def _meet(rows: DataFrame, anchors: DataFrame, grid: Grid, dim: int, n: int, n_anchors: int, k: int) -> DataFrame:
    """Found rows of every meeting of a block of rows and a block of anchors. Anchors with windows (columns positives,
    least, most) look for negatives, those without for positives."""
    nb, na = max(1, -(-n * dim // BLOCK_COMPONENTS)), max(LEAST_ANCHOR_BLOCKS, -(-n_anchors // BLOCK_ANCHORS))
    place = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("long")
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    left = rows.select(place(nb).alias("i"), every(na).alias("j"), "id", "label", "v", "code")
    positive = "positives" not in anchors.columns
    right = anchors.select(every(nb).alias("i"), place(na).alias("j"), *anchors.columns)

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple] = []
        if len(block) and len(asked):
            ids, labels, v = block["id"].to_numpy(), block["label"].to_numpy(), np.stack(block["v"])
            codes = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(-1, dim)
            for label, rows in asked.groupby("label"):
                near = np.flatnonzero(labels == label)
                known = Approximations(grid, codes[near] if positive else codes)
                for row, anchor, low, high in _bounded(rows, known):
                    if positive:
                        other = ids[near] != row.id
                        at, score, _ = best_positives(v[near[other]], ids[near[other]], low[other], high[other], anchor, k)
                        parts.append((np.full(len(at), row.id), np.full(len(at), -1), ids[near[other]][at], score))
                    else:
                        found, _ = window_negatives(v, ids, labels != label, low, high, anchor, list(zip(row.least, row.most)), k)
                        for one, (at, score) in zip(row.positives, found):
                            parts.append((np.full(len(at), row.id), np.full(len(at), one), ids[at], score))
        return _found(parts)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, asked: Column, label: Column, positives: int = 5, negatives: int = 3, floor: int = 50, ceiling: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each anchor (rows for which ``asked``, a condition on the column ``id``, holds) and each of its best
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score lies between ``floor``
    and ``ceiling`` hundredths of the positive's; ties to the smaller id. Fewer rows: all of them.

    Which rows take part, and what repeated ids give: see ``usable``. A positive score below zero has no negatives.
    Other columns are ignored; no usable row: no rows.
    """
    spark = rows.sparkSession
    prepare(spark)
    fine = saved(usable(rows, label, id_col, vec_col, scale))
    size = fine.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if size is None:
        return spark.createDataFrame([], SCHEMA)
    dim, n = size["dim"], size["n"]
    fine = fine.where(F.size("v") == dim)
    grid = grid_of(fine, dim, n)
    file = saved(coded(fine, grid, dim))
    anchors = saved(file.where(asked).select("id", "label", "v"))
    n_anchors = anchors.count()
    pairs = saved(_best(_meet(file, anchors, grid, dim, n, n_anchors, positives), positives).select(F.col("anchor_id").alias("id"), F.col("vec_id").alias("positive"), F.col("score").alias("p")))
    # whole numbers n with floor * p <= 100 * n <= ceiling * p: none where p is below zero
    window = F.struct("positive", F.expr(f"({floor} * p + 99) div 100").alias("least"), F.expr(f"{ceiling} * p div 100").alias("most"))
    windows = pairs.where("p >= 0").groupBy("id").agg(F.collect_list(window).alias("w"))  # at most ``positives`` an anchor
    windows = windows.select("id", F.col("w.positive").alias("positives"), "w.least", "w.most")
    found = _best(_meet(file, anchors.join(windows, "id"), grid, dim, n, n_anchors, negatives), negatives)
    scored = found.join(pairs.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("p").alias("positive_score")), ["anchor_id", "positive_id"])
    return scored.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
