"""The corpus pipeline against its operators, stage by stage, and on awkward tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillspark.llm import language_id, mixing, packing, registry, simhash, suffix_dedup
from quillspark.llm.common import bucket_of, discard, shared_dir, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        if name == "language_id":
            model = language_id.fit(docs, learn=bucket_of("doc_id", 4) != 2)
            p = language_id.predict(docs, model).where((F.col("__lang.lang_pred") != "und") & (F.col("__lang.score") >= P.LEAST_SCORE))
            assert {r.doc_id for r in after} == {r.doc_id for r in p.collect()}
        elif name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in after) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in after)
        elif name == "suffix_array_dedup":
            want = {r.doc_id: r["__dedup"] for r in suffix_dedup.dedup(docs, with_text=True).collect()}
            for r in after:
                assert r.text == (want[r.doc_id].kept_text if want[r.doc_id].n_removed else before[r.doc_id].text) and r.n_chars == len(r.text)
            assert {i for i, d in want.items() if d.kept_text or not d.n_removed} == {r.doc_id for r in after}
        elif name == "mixing":
            drawn = mixing.mix(docs, registry.domain(), registry.MIX_WEIGHTS, **registry.MIX).collect()
            words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
            want = Counter((r.doc_id, tuple(words(r.text)[: r["__mix"].take_tokens])) for r in drawn)
            assert Counter((r.doc_id, tuple(words(r.text))) for r in after) == want
            assert all(before[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text) for r in after)
            assert sum(len(words(r.text)) for r in after) == sum(r["__mix"].take_tokens for r in drawn) <= 0.8 * sum(len(words(r.text)) for r in before.values())
            assert any(r.text != before[r.doc_id].text for r in after)
        else:
            tokens = sum(len(packing.encode(r.text, packing.tokenizer_path(packing.VOCABULARY))) + 1 for r in docs.collect())
            assert sum(r.length for r in after) == tokens
        if name != "packing":
            assert out.columns == cols
        docs = out


def test_run(spark):
    """The pipeline leaves the tables of its last stages only, and those can be discarded."""
    before = written()
    assert P.run(spark, SF).count() > 0
    assert written() == before + 1
    discard(spark, before)
    assert written() == before


@pytest.mark.parametrize("table", ["nasty", "nothing"])
def test_awkward_tables(spark, request, table):
    docs = request.getfixturevalue(table)
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        path = f"{shared_dir(spark)}/awkward-{table}-{i}"
        out.write.mode("overwrite").parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
    assert (docs.count() > 0) == (table == "nasty")
