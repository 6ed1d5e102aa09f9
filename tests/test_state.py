"""Streams with keyed state against the same rows at once."""

import random

import pytest

from quillspark.streaming import latest, state

TURNS = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c}.{t}") for c in range(12) for t in range(1 + c % 5)]


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_in_any_order_of_files(spark, tmp_path, seed):
    rows, schema = TURNS[:], "conv_id long, turn long, role string, text string"
    random.Random(seed).shuffle(rows)
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for part in (rows[:11], rows[11:20] + rows[:3], rows[20:] + [(None, 0, "user", "lost"), (3, None, "user", "lost")]):
        put(spark, part, schema, source)
        state.kept(state.sessions(spark.readStream.schema(schema).parquet(str(source))), out, check)
    got = sorted(map(tuple, state.current(spark, out, "conv_id", state.SESSIONS).collect()))
    assert got == [(c, 1 + c % 5, f"text {c}.0", ",".join("user" if t % 2 == 0 else "assistant" for t in range(1 + c % 5))) for c in range(12)]
    assert spark.conf.get(state.STORE) != state.ROCKSDB


def test_annotations_in_any_order_of_files(spark, tmp_path):
    schema = "key string, timestamp string, label string, comment string"
    rows = [(f"k{i % 7}", f"2024-01-{i:02}", ("relevant", "partial", None)[i % 3], None if i % 4 else f"c{i}") for i in range(1, 29)]
    random.Random(3).shuffle(rows)
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for part in (rows[:9], rows[9:18], rows[18:] + rows[:2]):
        put(spark, part, schema, source)
        state.kept(state.latest_annotations(spark.readStream.schema(schema).parquet(str(source))), out, check)
    want = {tuple(r) for r in latest(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r) for r in state.current(spark, out, "key", state.LATEST).collect()} == want
