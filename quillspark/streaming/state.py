"""Keyed state: chat sessions and annotations that are kept up to date as rows arrive, in any order.

A key's state lives in Spark's state store and its checkpoint, not in a table that is read again; each batch gives the
new row of every key that it touched. ``kept`` writes these as a table by batch, and ``current`` reads the last row of
each key. A batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """Turns of a conversation: a turn that comes twice counts once, with its latest role and text. With ``idle`` seconds a
    session that has been silent so long is forgotten."""

    def __init__(self, idle: float = 0.0):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.roles = handle.getMapState("roles", "turn long", "role string")
        self.first = handle.getValueState("first", "turn long, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get() if self.first.exists() else None
        for part in rows:
            for turn, role, text in zip(part["turn"].tolist(), part["role"], part["text"]):
                self.roles.updateValue((turn,), (role,))
                if known is None or turn <= known[0]:
                    known = (turn, text)
        self.first.update(known)
        turns = sorted((k[0], v[0]) for k, v in self.roles.iterator())
        self._remind(timerValues)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [len(turns)], "title": [known[1]], "roles": [",".join(r for _, r in turns if r is not None)]})

    def _remind(self, timers) -> None:
        if self.idle:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.idle * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.roles.clear()
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


class Latest(StatefulProcessor):
    """The annotation of the newest timestamp of each key; of equal ones that of the largest label, then comment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "timestamp string, label string, comment string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order = lambda x: tuple((v is not None, v or "") for v in x)
        best = tuple(self.best.get()) if self.best.exists() else None
        for part in rows:
            for one in zip(part["timestamp"], part["label"], part["comment"]):
                if best is None or order(one) > order(best):
                    best = one
        self.best.update(best)
        yield pd.DataFrame({"key": [key[0]], "timestamp": [best[0]], "label": [best[1]], "comment": [best[2]]})

    def close(self) -> None:
        pass


SESSIONS = "conv_id long, turns long, title string, roles string"
LATEST = "key string, timestamp string, label string, comment string"


def sessions(turns: DataFrame, idle: float = 0.0) -> DataFrame:
    """(conv_id, turns, title, roles) of every conversation that a batch of ``turns`` (conv_id, turn, role, text) touches.
    Turns without a number are left out."""
    known = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    return known.groupBy("conv_id").transformWithStateInPandas(Sessions(idle), SESSIONS, "Update", "ProcessingTime" if idle else "None")


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """(key, timestamp, label, comment): the newest of each key that a batch touches."""
    known = annotations.where("key is not null").select("key", "timestamp", "label", "comment")
    return known.groupBy("key").transformWithStateInPandas(Latest(), LATEST, "Update", "None")


@contextmanager
def stateful(spark: SparkSession):
    """The state store that keyed state needs, put back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def kept(updates: DataFrame, output: str, checkpoint: str) -> None:
    """Takes what is there of a stream of updates and writes each batch to ``output``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    with stateful(updates.sparkSession):
        updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, output: str, key: str, schema: str) -> DataFrame:
    """The last row of each key."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(output)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
