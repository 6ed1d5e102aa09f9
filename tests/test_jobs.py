"""The jobs: growing input, repeated and broken runs, odd rows, command lines."""

import glob
import hashlib
import os
import subprocess
import sys

import pytest
from jobs import corpus_refresh, queries, retrieval_report
from pyspark.errors.exceptions.captured import StreamingQueryException
from quillspark.operators import lexical

from .oracle import compare

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    compare(queries.QUERIES[name](spark, f"/root/testdata/{sf}"), queries.SQL[name], f"/root/testdata/{sf}")


def put(spark, rows, folder):
    """Adds one file with the rows."""
    spark.createDataFrame(rows, corpus_refresh.DOCUMENTS).coalesce(1).write.mode("append").parquet(str(folder))


def kept(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["batch"]) for r in df.collect()), key=repr)


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""))


FIRST = [doc(5, "five"), doc(3, "same"), doc(1, "same", "fr"), doc(7, "stop this"), doc(8, None), doc(9, ""), doc(None, "lost"), doc(None, "five"), doc(2, "no language", None), doc(4, "blank language", ""), doc(5, "five")]
SECOND = [doc(0, "same"), doc(20, "new"), doc(21, "new", "de"), doc(22, "stop"), doc(23, "lost")]
CONFIG = corpus_refresh.Config(stop=["stop"])
AFTER_ONE = [(1, "same", "fr", 0), (2, "no language", None, 0), (4, "blank language", "", 0), (5, "five", "en", 0), (None, "lost", "en", 0)]
AFTER_TWO = sorted([*AFTER_ONE, (20, "new", "en", 1)], key=repr)


def test_refresh_takes_what_is_new(spark, tmp_path):
    docs, out = tmp_path / "in", str(tmp_path / "out")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    put(spark, FIRST, docs)
    assert kept(corpus_refresh.run(spark, str(docs), out, config=CONFIG)) == sorted(AFTER_ONE, key=repr)
    put(spark, SECOND, docs)
    assert kept(corpus_refresh.run(spark, str(docs), out, config=CONFIG)) == AFTER_TWO
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/corpus/batch=*/*/*.parquet")}
    assert kept(corpus_refresh.run(spark, str(docs), out, config=CONFIG)) == AFTER_TWO  # nothing new
    assert files == {f: os.path.getmtime(f) for f in glob.glob(f"{out}/corpus/batch=*/*/*.parquet")}
    assert sorted(map(tuple, corpus_refresh.batches(spark, out).collect())) == [(len(SECOND), 1, 1), (len(FIRST), 5, 0)]
    known = set(glob.glob(f"{docs}/*.parquet"))
    put(spark, [doc(30, "late")], docs)
    for f in set(glob.glob(f"{docs}/*.parquet")) - known:
        os.utime(f, (1e9, 1e9))  # an old file that comes late
    assert kept(corpus_refresh.run(spark, str(docs), out, config=CONFIG)) == sorted([*AFTER_TWO, (30, "late", "en", 2)], key=repr)
    assert {os.path.basename(p) for p in glob.glob(f"{out}/corpus/batch=0/*")} == {"folder=en", "folder=fr", "folder=und"}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    row = corpus_refresh.read(spark, out).where("doc_id = 20").first()
    assert row["chunk_id"] == hashlib.md5(b"s::20::new").hexdigest()[:12] and row["text_key"] == hashlib.md5(b"new").hexdigest() and (row["char_count"], row["n_tokens"]) == (3, 1)


def test_index_of_all_batches(spark, tmp_path):
    """An index that grew batch by batch finds what one over the whole corpus finds, with the same scores."""
    docs, out = tmp_path / "in", str(tmp_path / "out")
    rows = [doc(i, " ".join(f"word{i * j % 23}" for j in range(1, 2 + i % 17))) for i in range(120)]
    for part in (rows[:50], rows[40:90], rows[90:] + rows[:5]):
        put(spark, part, docs)
        whole = corpus_refresh.run(spark, str(docs), out, config=CONFIG)
    asked = spark.createDataFrame([(1, "word3 word7"), (2, "word22 word1 word1"), (3, "nothing")], "query_id long, text string")
    grown = lexical.search(corpus_refresh.index(spark, out), asked, 10)
    built = lexical.search(lexical.build(whole, "chunk_id"), asked, 10)
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, built.collect())) and grown.count() == 20


def test_index_is_a_row_a_document(spark, tmp_path):
    """A batch writes a row for each document, not for each of its words; batches of older versions have postings instead."""
    docs, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, [doc(i, f"own{i} " + " ".join(f"word{i * j % 23}" for j in range(1, 12))) for i in range(60)] + [doc(99, "a b")], docs)
    whole = corpus_refresh.run(spark, str(docs), out, config=CONFIG)
    read = lambda table: spark.read.parquet(f"{out}/{table}/batch=0")
    assert read("counts").count() == 60 and not glob.glob(f"{out}/postings/batch=*")
    asked = spark.createDataFrame([(1, "word3 word7"), (2, "word22 word1 word1")], "query_id long, text string")
    built = sorted(map(tuple, lexical.search(lexical.build(whole, "chunk_id"), asked, 10).collect()))
    assert sorted(map(tuple, lexical.search(corpus_refresh.index(spark, out), asked, 10).collect())) == built
    lexical.unpacked(read("counts")).select("term", "doc", "tf", "dl").write.parquet(f"{out}/postings/batch=0")
    assert sorted(map(tuple, lexical.search(corpus_refresh.index(spark, out), asked, 10).collect())) == built  # not twice
    os.rename(f"{out}/counts/batch=0", str(tmp_path / "gone"))
    spark.catalog.refreshByPath(out)
    assert sorted(map(tuple, lexical.search(corpus_refresh.index(spark, out), asked, 10).collect())) == built


def test_refresh_goes_on_after_a_broken_batch(spark, tmp_path, monkeypatch):
    """A run that breaks after the write and before the commit is repeated and leaves one copy of everything."""
    docs, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, FIRST, docs)
    corpus_refresh.run(spark, str(docs), out, config=CONFIG)
    put(spark, SECOND, docs)
    add = corpus_refresh.add_batch

    def broken(*args):
        add(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_refresh, "add_batch", broken)
    with pytest.raises(StreamingQueryException):
        corpus_refresh.run(spark, str(docs), out, config=CONFIG)
    assert kept(corpus_refresh.read(spark, out)) == AFTER_TWO
    monkeypatch.setattr(corpus_refresh, "add_batch", add)
    assert kept(corpus_refresh.run(spark, str(docs), out, config=CONFIG)) == AFTER_TWO
    # a commit that was lost: the batch is run again
    for f in ("1", ".1.crc"):
        os.remove(f"{out}/_checkpoint/commits/{f}")
    assert kept(corpus_refresh.run(spark, str(docs), out, config=CONFIG)) == AFTER_TWO


def test_refresh_by_files_gives_one_corpus(spark, tmp_path):
    docs, out = tmp_path / "in", str(tmp_path / "out")
    rows = [doc(i, f"text {i % 40}", "en" if i % 3 else "fr") for i in range(100)]
    for at in range(0, 100, 25):
        put(spark, rows[at : at + 25], docs)
    got = corpus_refresh.run(spark, str(docs), out, config=corpus_refresh.Config(files_per_batch=1)).collect()
    assert sorted(r["text"] for r in got) == sorted({t for _, t, *_ in rows}) and {r["batch"] for r in got} <= {0, 1, 2, 3}
    assert corpus_refresh.batches(spark, out).count() == 4


def test_refresh_refuses_a_foreign_checkpoint(spark, tmp_path):
    docs, out = tmp_path / "in", str(tmp_path / "out")
    for rows in (FIRST, SECOND):
        put(spark, rows, docs)
        corpus_refresh.run(spark, str(docs), out, config=CONFIG)
    with pytest.raises(StreamingQueryException, match="holds batch 1"):
        corpus_refresh.run(spark, str(docs), out, str(tmp_path / "other"), CONFIG)
    assert kept(corpus_refresh.read(spark, out)) == AFTER_TWO


def test_refresh_of_nothing(spark, tmp_path):
    docs, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, [], docs)
    assert corpus_refresh.run(spark, str(docs), out).count() == 0
    put(spark, [doc(1, None), doc(2, "")], docs)
    assert corpus_refresh.run(spark, str(docs), out).count() == 0


def test_report_is_repeated_and_extended(spark, tmp_path):
    paths, out = [f"{SF}/{t}.parquet" for t in ("documents", "benchmark", "labels")], str(tmp_path / "out")
    config = retrieval_report.load(f"{ROOT}/jobs/retrieval_report.json")
    key = lambda df: sorted(map(repr, df.collect()))
    first = key(retrieval_report.run(spark, *paths, out, config))
    assert key(retrieval_report.run(spark, *paths, out, config)) == first and len(first) == 80
    one = retrieval_report.Config(configurations=[retrieval_report.Configuration("narrow", 2)])
    both = retrieval_report.run(spark, *paths, out, one)
    assert both.count() == 120 and key(both.where("config <> 'narrow'")) == first
    summary = {r["config"]: r for r in spark.read.parquet(f"{out}/summary").collect()}
    assert set(summary) == {"bm25", "bm25_rerank", "narrow"} and summary["narrow"]["n_queries"] == 40 and summary["narrow"]["p5_strict"] <= summary["bm25"]["p5_strict"]


def test_report_of_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red green blue", "a"), (1, "red green blue", "a"), (None, "red", "b"), (3, None, None), (4, "", "c")], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(0, "red blue"), (1, None), (2, "nothing")], "item_id long, text string")
    labels = spark.createDataFrame([(50, 1, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for name, df in (("d", docs), ("q", asked), ("l", labels)):
        df.write.parquet(str(tmp_path / name))
    got = retrieval_report.run(spark, *(str(tmp_path / n) for n in "dql"), str(tmp_path / "out"))
    assert got.count() == 6 and got.where("p5_strict > 0").count() == 0


def test_command_lines(tmp_path):
    env = {**os.environ, "PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    conf = ["--config", f"{ROOT}/jobs/corpus_refresh.json"]
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
    done = run("jobs.corpus_refresh", "--documents", f"{SF}/documents.parquet", "--output", str(tmp_path / "c"), *conf)
    assert done.returncode == 0 and "batch 0: read 200 documents" in done.stderr, done.stderr[-2000:]
    conf = ["--config", f"{ROOT}/jobs/retrieval_report.json"]
    done = run("jobs.retrieval_report", "--documents", f"{SF}/documents.parquet", "--questions", f"{SF}/benchmark.parquet", "--labels", f"{SF}/labels.parquet", "--output", str(tmp_path / "r"), *conf)
    assert done.returncode == 0 and "configuration bm25_rerank: 40 questions" in done.stderr, done.stderr[-2000:]
