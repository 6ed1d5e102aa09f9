"""Approximate vector search in a stored index: an inverted file of residual product-quantised codes.

Vectors are dealt to cells, the nearest of a set of centroids; what is left of a vector is cut into subspaces, and in each
replaced by the number of the nearest entry of a codebook. The index is a Parquet table partitioned by cell, with a code
of one byte a subspace beside each vector. A query looks into the ``probes`` cells whose centroids it is nearest to, adds
up the products of its parts with the codebooks by table lookup, and scores its best ``refine`` finds a query exactly.

Scaling. Only the folders of probed cells are read, and of them first only ids and codes; vectors are read for rows that
are scored again. Rows of a cell are dealt over blocks by a hash of the id, so that a cell with a third of all vectors
is many tasks. Centroids and codebooks are fitted on a bounded sample and sent to the tasks; their size follows from the
number of cells, which has a bound. New vectors are added with the model that is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved
from .vector import BLOCK_QUERIES, BLOCK_VECTORS, DIGITS

#: Bound of the sample that is fitted on, of cells, dimensions of a subspace, rounds of fitting and seed.
SAMPLE, MOST_CELLS, SUBSPACE, ROUNDS, SEED = 32_768, 65_536, 2, 10, 3
#: Finds of a query that are scored exactly, for each wanted one, at least; recall that these and the probes are chosen for;
#: queries of the sample.
REFINE, WANTED, SAMPLE_QUERIES = 20, 0.97, 200
#: Entries of a codebook.
ENTRIES = 256


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point."""
    return ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)


def clustered(points: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """n centres (fewer points: as many) by Lloyd's rounds; an empty one stays where it was."""
    centres = points[rng.permutation(len(points))[:n]].copy()
    for _ in range(rounds):
        which = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, which, points)
        count = np.bincount(which, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


@dataclass
class Model:
    centroids: np.ndarray  # cell by dimension
    books: list[np.ndarray]  # for each subspace: entry by its dimensions
    probes: int
    refine: int = REFINE
    share: float = 1.0  # of the sample's vectors in the probed cells
    recall: float = 0.0  # reached on the sample

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([b.shape[1] for b in self.books])[:-1]
        return np.split(vectors, ends, axis=1)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each vector."""
        cell = nearest(vectors, self.centroids)
        codes = [nearest(p, b) for p, b in zip(self.parts(vectors - self.centroids[cell]), self.books)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def cells(self, queries: np.ndarray) -> np.ndarray:
        """Cells of each query, the likeliest first."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Products of the query's parts with the entries of the codebooks (subspace by entry)."""
        out = np.zeros((len(self.books), ENTRIES))
        for row, part, book in zip(out, self.parts(query[None]), self.books):
            row[: len(book)] = book @ part[0]
        return out

    def approximate(self, query: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of vectors by their cells and codes (subspace by vector)."""
        return (self.centroids @ query)[cell] + self.tables(query)[np.arange(len(self.books))[:, None], codes].sum(0)


def fitted(vectors: np.ndarray, cells: int, k: int = 10, wanted: float = WANTED, seed: int = SEED, subspace: int = SUBSPACE, refine: int = REFINE) -> Model:
    """A model of the sampled vectors. Of k neighbours there, the wanted share has to be found: ``refine`` is doubled until
    the codes allow it, then the fewest probes are taken that reach it."""
    rng = np.random.default_rng(seed)
    centroids = clustered(vectors, max(1, cells), ROUNDS, rng)
    left = vectors - centroids[nearest(vectors, centroids)]
    books = [clustered(p, ENTRIES, ROUNDS, rng) for p in np.split(left, range(subspace, vectors.shape[1], subspace), axis=1)]
    model = Model(centroids, books, len(centroids), refine)
    cell, codes = model.encode(vectors)
    flat, size = codes.T.astype(np.intp), np.bincount(cell, minlength=len(centroids))
    # of each neighbour: the probe that opens its cell, and how many vectors have a better rough score
    probe, better, share = [], [], np.zeros(len(centroids))
    queries = rng.permutation(len(vectors))[:SAMPLE_QUERIES]
    for q in queries:
        score = vectors @ vectors[q]
        score[q] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(vectors) - 1)]
        rough = model.approximate(vectors[q], cell, flat)
        order = model.cells(vectors[q : q + 1])[0]
        probe.append(np.argsort(order)[cell[best]])
        better.append(len(rough) - np.searchsorted(np.sort(rough), rough[best], "right"))
        share += np.cumsum(size[order]) / len(vectors) / len(queries)
    probes, betters = np.concatenate(probe), np.concatenate(better)
    while len(betters) and (betters < model.refine * k).mean() < wanted:
        model.refine *= 2
    found = np.bincount(probes[betters < model.refine * k], minlength=len(centroids)).cumsum() / max(1, len(probes))
    enough = np.flatnonzero(found >= wanted)
    model.probes = int(enough[0]) + 1 if len(enough) else len(centroids)
    model.share, model.recall = float(share[model.probes - 1]), float(found[model.probes - 1])
    return model


def cells_for(n: int) -> int:
    """About as many cells as a cell has vectors."""
    return int(min(MOST_CELLS, max(1, n**0.5)))


def grouped(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(cell, group, blocks): neighbouring cells in groups of about ``BLOCK_VECTORS`` vectors; a cell that holds more is a
    group of its own, dealt over blocks."""
    out, group, filled = [], 0, 0
    for cell, n in sorted(sizes.items()):
        if filled + n > BLOCK_VECTORS:
            group, filled = group + 1, 0
        out.append((cell, group, -(-n // BLOCK_VECTORS)))
        filled += n
    return out


VECTORS = "id long, code binary, embedding array<double>, cell int"
MODEL = "part string, number int, v array<double>"


@dataclass
class Index:
    spark: SparkSession
    path: str
    model: Model

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(f"{self.path}/vectors")

    def add(self, vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", mode: str = "append") -> None:
        """Appends vectors to their cells. Ids are not made unique."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = np.array(batch.column(1).to_pylist(), np.float64)
                    cell, codes = model.encode(v)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(cell, pa.int32())], names=["id", "code", "embedding", "cell"])

        rows = vectors.select(F.col(vec).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
        # one or a few files for each cell, however many vectors it has
        rows.mapInArrow(run, VECTORS).hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/vectors")

    def probed(self, queries: DataFrame, query: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """(query_id, q, cell): the cells that each query looks into."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = model.cells(np.array(batch.column(1).to_pylist(), np.float64))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "cells"])

        rows = queries.select(F.col(query).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("q"))
        return rows.mapInArrow(run, "query_id long, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int, query: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """(query_id, rank from 0, vec_id, score): the k best found by inner product, as ``vector.topk`` has them. Scores are
        exact; a query finds fewer than k only if its cells hold fewer."""
        model = self.model
        asked = saved(self.probed(queries, query, embedding))
        cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most all cells: MOST_CELLS
        there = self.vectors().where(F.col("cell").isin(cells))  # folders of other cells are not read
        sizes = {r["cell"]: r["count"] for r in there.groupBy("cell").count().collect()}
        groups = self.spark.createDataFrame(grouped(sizes), "cell int, g int, vs long")
        qs = max(1, -(-asked.select("query_id").distinct().count() // BLOCK_QUERIES))
        salt = lambda key, by: F.pmod(F.xxhash64(key), by)
        each = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), upto - 1))
        left = there.select("cell", "id", "code").join(F.broadcast(groups), "cell").select(F.col("g").alias("g"), salt("id", F.col("vs")).alias("i"), each(F.lit(qs).cast("long")).alias("j"), "cell", "id", "code")
        by_group = asked.join(F.broadcast(groups), "cell").groupBy("query_id", "q", "g", "vs").agg(F.collect_list("cell").alias("cells"))
        right = by_group.select(F.col("g").alias("g"), each(F.col("vs")).alias("i"), salt("query_id", F.lit(qs)).alias("j"), "query_id", "q", "cells")
        most = model.refine * k

        def meet(vectors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            parts: list[tuple] = []
            if len(vectors) and len(rows):
                vectors = vectors.sort_values("cell", kind="stable")
                ids, cell = vectors["id"].to_numpy(), vectors["cell"].to_numpy()
                codes = np.frombuffer(b"".join(vectors["code"]), np.uint8).reshape(len(ids), -1).T.astype(np.intp)
                for one, q, probed in zip(rows["query_id"], rows["q"], rows["cells"]):
                    q, low, high = np.asarray(q), np.searchsorted(cell, probed, "left"), np.searchsorted(cell, probed, "right")
                    at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
                    rough = model.approximate(q, cell[at], codes[:, at])
                    best = np.argpartition(-rough, most)[:most] if len(rough) > most else np.arange(len(rough))
                    parts.append((np.full(len(best), one), ids[at[best]], rough[best], cell[at[best]]))
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
            return pd.DataFrame(dict(zip(("query_id", "id", "rough", "cell"), cols)))

        found = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(meet, "query_id long, id long, rough double, cell int")
        rough = Window.partitionBy("query_id").orderBy(F.desc("rough"), "id")
        finds = found.withColumn("r", F.row_number().over(rough)).where(F.col("r") <= most).select("query_id", "id", "cell")
        exact = finds.join(there.select("cell", "id", "embedding"), ["cell", "id"]).join(asked.select("query_id", "q", "cell"), ["query_id", "cell"])
        product = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        scored = exact.select("query_id", F.col("id").alias("vec_id"), F.round(product, DIGITS).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k).select("query_id", (F.col("__n") - 1).alias("rank"), "vec_id", "score")


def sampled(vectors: DataFrame, embedding: str, n: int) -> np.ndarray:
    """At most ``SAMPLE`` vectors, the first by a hash of the vector."""
    rows = vectors.select(F.col(embedding).cast("array<double>").alias("e"))
    near = rows.where(F.rand(SEED) < min(1.0, 2 * SAMPLE / max(1, n))).orderBy(F.xxhash64("e")).limit(SAMPLE).collect()
    return np.array([r["e"] for r in near], np.float64)


def build(vectors: DataFrame, path: str, cells: int | None = None, vec: str = "vec_id", embedding: str = "embedding", **settings) -> Index:
    """Fits a model on a sample and writes the index over all vectors to ``path``, in place of one that is there. Vectors
    have one length and no null. Further settings are those of ``fitted``."""
    spark, n = vectors.sparkSession, vectors.count()
    sample = sampled(vectors, embedding, n)
    if not len(sample):
        raise ValueError("no vectors to index")
    model = fitted(sample, min(cells or cells_for(n), len(sample)), **settings)
    rows = [("centroid", i, c.tolist()) for i, c in enumerate(model.centroids)]
    rows += [(f"book {m}", i, c.tolist()) for m, book in enumerate(model.books) for i, c in enumerate(book)]
    rows += [("settings", 0, [float(model.probes), float(model.refine), model.share, model.recall])]
    spark.createDataFrame(rows, MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    index = Index(spark, path, model)
    index.add(vectors, vec, embedding, "overwrite")
    return index


def load(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` wrote."""
    parts: dict[str, list[tuple[int, list[float]]]] = {}
    for r in spark.read.schema(MODEL).parquet(f"{path}/model").collect():  # the model: bounded by the number of cells
        parts.setdefault(r["part"], []).append((r["number"], r["v"]))
    stacked = {p: np.array([v for _, v in sorted(rows)]) for p, rows in parts.items()}
    probes, refine, share, recall = stacked["settings"][0]
    books = [stacked[f"book {m}"] for m in range(len(stacked) - 2)]
    return Index(spark, path, Model(stacked["centroid"], books, int(probes), int(refine), float(share), float(recall)))
