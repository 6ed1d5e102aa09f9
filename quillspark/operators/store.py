"""A collection of documents with vectors: Parquet tables below a folder, by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Store as Settings
from ..session import discarding
from . import blockmax, corpus, ivf, lexical, vector


class Backend(ValueError):
    """A backend that is not known."""


#: Subfolders: documents by batch, the batches that count, and the indexes of each.
DOCS, BATCHES, LEXICAL, VECTORS = "docs", "batches", "lexical", "vectors"
STATES = "n_docs long, n_all long, begin int, approximate boolean, batch int"

@dataclass(frozen=True)
class State:
    """What a batch left: documents of batches from ``begin`` to ``batch``, ``n_all`` of them."""

    batch: int
    begin: int
    n_all: int
    approximate: bool


@dataclass
class Collection:
    """Documents (chunk_id and further columns) with an embedding each, one for each chunk_id: one that is there already
    stays as it is, and of new ones with one id the first by text counts. ``doc`` numbers them uniquely.

    An addition is a batch: its documents, then the lexical index over all documents, plain and pruned in one, and, if wanted, the index of their
    vectors, each in a folder of the batch, and last a row that says the batch is there. Readers take the last such row
    and what it names; so a batch that broke off changes nothing, and the next one writes over it. Resetting is an
    addition that begins anew. One writer at a time.
    """

    spark: SparkSession
    path: str

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def state(self) -> State | None:
        """The last batch that counts."""
        files, at = self._fs(f"{self.path}/{BATCHES}")
        if not files.exists(at):
            return None
        row = self.spark.read.schema(STATES).parquet(f"{self.path}/{BATCHES}").orderBy(F.desc("batch")).first()
        return row and State(row["batch"], row["begin"], row["n_all"], row["approximate"])

    def exists(self) -> bool:
        return self.state() is not None

    def scan(self, state: State | None = None) -> DataFrame:
        """All documents, as of a state."""
        state = state or self.state()
        rows = self.spark.read.parquet(f"{self.path}/{DOCS}")
        return rows.where(F.col("batch").between(state.begin, state.batch)).drop("batch")

    def count(self) -> int:
        state = self.state()
        return state.n_all if state else 0

    def lexical(self, state: State | None = None) -> str:
        """Folder of the lexical index."""
        return f"{self.path}/{LEXICAL}/{(state or self.state()).batch}"

    def add(self, docs: DataFrame, embed: Callable[[list[str]], np.ndarray] | None, text: str = "embedding_text", batch: int = 100, reset: bool = False, approximate: bool = False) -> State:
        """Adds docs as one batch and makes it count. Embeds the column ``text``, which is not kept; without a function
        docs bring an ``embedding``. ``reset``: only these documents are left. ``approximate``: vectors are indexed too."""
        with discarding(self.spark):
            return self._add(docs, embed, text, batch, reset, approximate)

    def _add(self, docs: DataFrame, embed: Callable[[list[str]], np.ndarray] | None, text: str, batch: int, reset: bool, approximate: bool) -> State:
        spark, before = self.spark, self.state()
        number = before.batch + 1 if before else 0
        begin = number if reset or not before else before.begin
        rest = [c for c in docs.columns if c != "chunk_id"]
        fresh = docs.join(self.scan(before).select("chunk_id"), "chunk_id", "left_anti") if begin < number else docs
        first = fresh.groupBy("chunk_id").agg(F.min_by(F.struct(*rest), F.struct("page_content", F.xxhash64(*rest))).alias("r")).select("chunk_id", "r.*")
        start = 0 if begin == number else before.n_all
        placed = corpus.positioned(first, [F.col("chunk_id")], "doc").withColumn("doc", F.col("doc") + start)
        made = placed if embed is None else vector.embed(placed, text, embed, "embedding", batch).drop(text)
        made.drop("batch").write.mode("overwrite").parquet(f"{self.path}/{DOCS}/batch={number}")
        n = spark.read.parquet(f"{self.path}/{DOCS}/batch={number}").count()
        state = State(number, begin, start + n, approximate)
        everything, known = self.scan(state), self._counted(before) if begin < number else None
        blockmax.save(everything if known is None else everything.where(F.col("doc") >= start), self.lexical(state), doc="doc", text="page_content", known=known)
        if approximate:
            ivf.build(everything, f"{self.path}/{VECTORS}/{number}", vec="doc")
        self._commit(state, n)
        return state

    def _counted(self, state: State) -> DataFrame | None:
        """Counts of all documents of a state, as its index has them: an addition tokenises its own documents only. None
        where there is no such index of this version."""
        try:
            return lexical.load(self.spark, self.lexical(state), state.n_all).packed
        except (ValueError, AnalysisException):
            return None

    def _commit(self, state: State, n: int) -> None:
        row = self.spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(state.n_all).cast("long").alias("n_all"), F.lit(state.begin).alias("begin"), F.lit(state.approximate).alias("approximate"))
        row.write.mode("overwrite").parquet(f"{self.path}/{BATCHES}/batch={state.batch}")

    def prune(self) -> None:
        """Deletes what the last state does not name: hidden documents, older indexes, and what a broken batch left."""
        state = self.state()
        if state is None:
            return
        for folder, keep in ((DOCS, lambda n: state.begin <= n <= state.batch), (LEXICAL, lambda n: n == state.batch), (VECTORS, lambda n: n == state.batch)):
            files, at = self._fs(f"{self.path}/{folder}")
            for entry in files.listStatus(at) if files.exists(at) else []:
                name = entry.getPath().getName()
                if not keep(int(name.split("=")[-1])):
                    files.delete(entry.getPath(), True)

    def search(self, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
        """(query_id, rank, score, document columns) of the k nearest of each query (query_id, embedding); by the index of
        vectors where the state has one, else exactly."""
        state = self.state()
        docs = self.scan(state)
        if state.approximate:
            found = ivf.load(self.spark, f"{self.path}/{VECTORS}/{state.batch}").search(queries, k)
            found = found if threshold is None else found.where(F.col("score") >= threshold)
        else:
            found = vector.topk(docs, queries, k, "doc", threshold=threshold)
        return found.join(docs.drop("embedding"), found["vec_id"] == docs["doc"]).drop("vec_id")


def open_collection(spark: SparkSession, settings: Settings = Settings()) -> Collection:
    """The collection that settings name; a backend that is not known is an error."""
    if settings.backend != "parquet":
        raise Backend(f"unknown backend {settings.backend}")
    return Collection(spark, f"{settings.path.rstrip('/')}/{settings.collection}")
