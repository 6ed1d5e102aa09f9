"""Small goldens and brute-force versions of the reference operators."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark import sources
from quillspark.config import Chunking, load
from quillspark.functions import text as X
from quillspark.operators import chunking, corpus, evaluate, fusion, lexical, query, vector
from quillspark.operators import html as H
from quillspark.plans import Retriever, ablation_grid, build_corpus, clean_corpus
from quillspark.streaming import append_new, chunk_stream, latest

PAGE = """<p class="topictitle">Title</p><p id="ptopic_breadcrumbs"><a href="a.html">Root</a><a href="b.html">Part</a></p>
<div id="hmpagebody_scroller">
<p class="p_bodytext"><span style="font-weight: bold;">Cur</span><span> is</span></p>
<p class="p_Head4"><span class="f_Head4">Section</span></p>
<p class="p_Numbered"><span style="display:inline-block;margin-left:-1rem">1.</span>Step</p>
<table><tr><td>H1</td><td colspan="2">H2</td></tr><tr><td>a|b</td></tr></table>
<table><tr><td><img src="note.png"></td><td>Careful</td></tr></table>
<p class="p_bodytext"><a class="hmanchor" name="x"></a></p>
<div class="topicfooter">(c)</div></div>"""


def test_tokens(spark):
    row = spark.createDataFrame([("Привет, м²и½ naïve_x ab abc",)], "t string").select(X.tokens(F.col("t"))).first()
    assert row[0] == ["привет", "м²и½", "naïve_x", "abc"]


def test_blocks_of_a_page():
    title, crumbs, blocks = H.page_blocks(PAGE)
    assert (title, crumbs) == ("Title", "Root → Part")
    assert [b[0] for b in blocks] == ["PARAGRAPH", "SECTION_HEADING", "NUMBERED_STEP", "TABLE", "NOTE", "ANCHOR", "FOOTER"]
    assert blocks[0][1] == "**Cur** is" and blocks[1][1] == "#### Section" and blocks[2][1] == "1. Step"
    assert blocks[3][1] == "| H1 | H2 |   |\n| --- | --- | --- |\n| a\\|b |   |   |"
    assert "Примечание" in blocks[4][1] and "Careful" in blocks[4][1]


def test_markdown_of_a_page(spark):
    df = spark.createDataFrame([("a.html", PAGE), ("b.html", "<p>no root</p>"), ("c.html", None)], "source_file string, html string")
    out = chunking.markdown(df)
    got = {r["source_file"]: r["markdown"] for r in out.collect()}
    assert chunking.markdown_counters(out).first().asDict() == {"total": 3, "converted": 1, "skipped": 2, "errors": 0}
    # the page rules take white space before and after ** away, line ends too, and put some back between letters
    assert got["a.html"].startswith("# Title\n\n>**Путь:**Root → Part **Cur **is\n\n#### Section\n\n1. Step\n\n| H1 | H2 | |\n") and got["b.html"] is None and got["c.html"] is None


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<p>a<br>b</p>", "a\nb"),
        ("<p><a href='x.html'>L</a> <a href='http://y/z.html'>M</a></p>", "[L](x.md) [M](http://y/z.html)"),
        ("<p><span class='f_Z_SUPER'>2</span><span class='f_Z_SUB'>i</span></p>", "^2^~i~"),
        ("<h2>T</h2>", "## T"),
        ("<hr>", "---"),
        ("<p><img src='s.png' alt='A'></p>", "![A](s.png)"),
        ("<p><img src='s.png' alt='A' style='width:1.5rem;height:1rem'></p>", "![A](s.png)"),
        ("<p><img class='dropdown-toggle-icon' src='s.png' alt='A'>x</p>", "x"),
        ("<p class='p_bulleted2'>x</p>", "- x"),
        ("<script>bad()</script><!-- c --><p>ok</p>", "ok"),
    ],
)
def test_markdown_of_elements(html, markdown):
    make = H.Converter(H.Options(metadata=False))
    assert make.page(f"<div id='hmpagebody_scroller'>{html}</div>") == markdown


def test_chunks(spark):
    df = spark.createDataFrame([("a.html", PAGE)], "source_file string, html string")
    toc = spark.createDataFrame([("a.html", "T", "B", 1, "", False)], sources.TOC_SCHEMA)
    rows = build_corpus(df, toc).orderBy("chunk_index").collect()
    assert [r["section_title"] for r in rows] == ["Section"] and rows[0]["has_table"] and rows[0]["has_procedure"] and rows[0]["breadcrumbs"] == "Root → Part"


def test_splits():
    parts = chunking.split_text("aaaaaa\n\nbbbbb\n\n" + "c" * 20, 10)
    assert [len(p) for p in parts] == [6, 5, 20]
    assert chunking.greedy([0, 0, 20], 10) == [0, 0, 1]  # empty paragraphs make a group that is not empty
    table = "| h |\n| --- |\n| 1 |\n| 2 |\n| 3 |"
    assert chunking.split_table(table, 26) == ["| h |\n| --- |\n| 1 |\n| 2 |", "| h |\n| --- |\n| 3 |"]
    rng = random.Random(3)
    for _ in range(50):
        text = "\n\n".join("x" * rng.randrange(12) for _ in range(rng.randrange(1, 9)))
        assert "\n\n".join(chunking.split_text(text, 15)) == text


def test_continuation_header_and_small_chunks():
    blocks = [("SECTION_HEADING", "#### S", "S")] + [("PARAGRAPH", "word " * 60, "")] * 4
    rows = chunking.chunk_page("f", "T", "", blocks, Chunking(target=400))
    assert len(rows) > 1 and rows[1]["text"].startswith("## S\n\n") and [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_dedup(spark):
    rows = [("t", "f1", 0), ("u", "f2", 1), ("t", "f3", 2), ("t", "f3", 3)]
    df = spark.createDataFrame(rows, "text string, source_file string, ord int")
    assert {(r.text, r.source_file, r.alt_sources) for r in corpus.deduplicate(df).collect()} == {("t", "f1", "f3;f3"), ("u", "f2", "")}
    df = spark.createDataFrame([("t", x, i) for i, x in enumerate(["f1", "", "f2", ""])], "text string, source_file string, ord int")
    assert corpus.deduplicate(df).first()["alt_sources"] == "f2;"


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_segments_are_the_alternative_sources(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice("tuvw"), rng.choice(["", None, "f1", "f2"]), i) for i in range(60)] + [("x", "f", 99), ("y", "", 100), ("y", None, 101)]
    df = spark.createDataFrame(rows, "text string, source_file string, ord int").repartition(5)
    parts = {}
    for r in corpus.alternative_sources(df, most=most).collect():
        assert 1 <= len(r["names"]) <= most
        parts.setdefault(r["key"], {})[r["segment"]] = r["names"]
    want = {hashlib.md5(r.text.encode()).hexdigest(): r.alt_sources for r in corpus.deduplicate(df).collect()}
    assert {k: ";".join(n for _, s in sorted(v.items()) for n in s) for k, v in parts.items()} == {k: v for k, v in want.items() if v}


def test_upper_median(spark):
    df = spark.createDataFrame([(i,) for i in (4, 1, 3, 2)], "v int")
    assert corpus.upper_median(df, "v").first()[0] == 3
    rng = random.Random(4)
    for values in ([7], [5, 5], [-3, -3, 10**12], [rng.randrange(-(10**9), 10**9) for _ in range(501)], [rng.randrange(3000) ** 2 for _ in range(400)] + [None] * 90):
        known = sorted(v for v in values if v is not None)
        assert corpus.upper_median(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()[0] == known[len(known) // 2]
    assert corpus.upper_median(spark.createDataFrame([], "v int"), "v").first()[0] is None


def test_rrf(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "b"), (1, 1, 1, "c"), (2, 0, 0, "a"), (2, 1, 0, "b")]
    got = fusion.fuse(spark.createDataFrame(rows, "query_id int, list_idx int, rank int, doc string")).orderBy("query_id", "rank").collect()
    assert [r.doc for r in got] == ["b", "a", "c", "a", "b"] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-8


def test_merge(spark):
    rows = [(1, "f", 0, 7, "seven", "m7"), (1, "f", 1, 3, "three", "m3"), (1, "f", 2, 5, "five", "m5"), (1, "g", 3, 1, "one", "m1")]
    df = spark.createDataFrame(rows, "query_id int, source_file string, rank int, chunk_index int, text string, meta string")
    got = {r.source_file: r for r in fusion.merged(df).collect()}
    assert got["f"].text == "three\n\nseven" and got["f"].meta == "m7" and got["f"].merged_chunks == 2 and got["g"].merged_chunks is None


def test_bm25_by_hand(spark, tmp_path):
    df = spark.createDataFrame([(0, "cat dog cat"), (1, "dog bird"), (2, "fish"), (3, "")], "doc_id int, text string")
    index = lexical.build(df)
    q = spark.createDataFrame([(9, "cat")], "query_id int, text string")
    import math

    idf, avgdl = math.log(3.5) - math.log(1.5), 6 / 4
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl))
    got = lexical.search(index, q).collect()
    assert [(r.doc, round(r.score, 5)) for r in got] == [(0, round(want, 5))]
    index.save(str(tmp_path / "i"))
    again = lexical.load(spark, str(tmp_path / "i"), 4)
    assert lexical.search(again, q).collect() == got
    with pytest.raises(ValueError):
        lexical.load(spark, str(tmp_path / "i"), 5)


def test_hybrid_retrieval(spark):
    docs = spark.createDataFrame([(i, f"f{i % 3}", i, t) for i, t in enumerate(["red apple pie", "green apple tart", "blue sky", "apple apple apple"])], "doc long, source_file string, chunk_index int, text string")
    model = vector.hashing_embedder(16)
    vectors = vector.embed(docs.select("doc", "text"), "text", model).select("doc", "embedding")
    r = Retriever(docs, lexical.build(docs, "doc"), vectors)
    q = vector.embed(spark.createDataFrame([(1, 0, "apple pie")], "query_id long, list_idx int, text string"), "text", model)
    for mode in ("bm25", "vector", "hybrid"):
        assert r.retrieve(q, mode).count() >= 1
    with pytest.raises(ValueError):
        r.ranked(q, "other", 5)
    reranked = r.retrieve(q, "hybrid", logit=query.overlap_logit(F.col("question"), F.col("text")), questions=q.select("query_id", "text"))
    assert "red apple pie" in reranked.orderBy("rank").first()["text"]
    assert len(ablation_grid()) == 12


def test_metrics(spark):
    rows = [(0, 1, "irrelevant"), (0, 2, "relevant"), *((1, i, "irrelevant") for i in range(1, 6))]
    got = {r.query_idx: r for r in evaluate.query_metrics(spark.createDataFrame(rows, "query_idx int, rank int, label string")).collect()}
    assert abs(got[0].ndcg5 - 0.63093) < 1e-5 and got[0].mrr_strict == 0.5 and got[0].p5_strict == 0.2
    assert (got[1].ndcg5, got[1].mrr_strict, got[1].recall5_strict) == (0, 0, 0)


def test_judgment(spark):
    df = spark.createDataFrame([('```json\n{"relevance": {"score": "yes", "reason": "r"}}\n```',), ("nonsense",)], "t string")
    good, bad = [r[0] for r in df.select(evaluate.judgment(F.col("t"))).collect()]
    assert good["relevance"]["score"] == "yes" and bad["faithfulness"]["score"] == "error" and bad["helpfulness"]["reason"] == "nonsense"


def test_citations():
    refs = [{"number": i, "url": f"u{i}", "page_title": f"T{i}", "section_path": ""} for i in (1, 2)]
    got = query.cite("a [1] b [02] [[1]] [1](x) [9]", refs)
    assert got.startswith("a [[1]](u1) b [[2]](u2) [[1]] [1](x) [9]\n\n**Источники:**") and got.count("\n- ") == 2
    for tail in ("Источники: нет", "---\n**Источник**", "### источники", "**Источники**: нет"):
        assert query.cite(f"nothing\n\n{tail}", refs) == "nothing"
    assert query.cite("nothing\n\nSources: none", refs) == "nothing\n\nSources: none"
    assert query.cite("a\nИсточники: [2] [7]", refs) == "a\n\n**Источники:**\n- [2] [T2](u2)"


def test_rewrites(spark):
    got = spark.createDataFrame([("question", "- abc\n- abcdef\nnoise\n- QUESTION")], "q string, r string").select(query.rewrites(F.col("q"), F.col("r"))).first()[0]
    assert got == ["question", "abcdef"]


def test_toc():
    script = 'hmLoadTOC({\n items: [\n{ cp: "A", hf: "a.html", lv: 1, items: [\n{ cp: "B", hf: "b.html", lv: 2, },\n],\n},\n{ cp: "C", hf: "a.html", lv: 1 }\n]\n})'
    script = script.replace("{ cp", "{\ncp").replace(", hf", ",\nhf").replace(", lv", ",\nlv").replace(", items", ",\nitems")
    rows = {r[0]: r for r in sources.toc_rows(script)}
    assert rows["b.html"][2] == "A → B" and rows["a.html"][1] == "C" and sources.toc_rows("nothing") == []


def toc_nodes(script):
    """The tree of a script as rows of nodes, in reading order."""
    body = script[script.index("{") : script.rindex("}") + 1]
    out, todo = [], [(None, i, x) for i, x in enumerate(json.loads(body)["items"])]
    while todo:
        parent, at, x = todo.pop(0)
        out.append((1, len(out), parent, at, x.get("cp"), x.get("hf"), x.get("lv"), x.get("tp")))
        todo += [(len(out) - 1, i, y) for i, y in enumerate(x.get("items", []))]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk_equals_reading(spark, seed):
    rng = random.Random(seed)

    def items(depth):
        return [{"cp": rng.choice(["", None, f" t{rng.random()} "]), "hf": rng.choice(["", f"f{rng.randrange(12)}"]), "lv": rng.choice([None, depth]), "tp": "x", **({"items": items(depth + 1)} if rng.random() < 0.6 and depth < 6 else {})} for _ in range(rng.randrange(1, 4))]

    script = "hmLoadTOC(" + json.dumps({"items": items(1) + items(1)}) + ")"
    schema = "toc int, node long, parent long, position int, title string, source_file string, level int, topic_type string"
    nodes = toc_nodes(script)
    two = nodes + [(2, *n[1:]) for n in nodes] + [(3, 0, 1, 0, "a", "a.html", 1, ""), (3, 1, 0, 0, "b", "b.html", 1, ""), (4, 0, None, 0, "r", "r.html", 1, ""), (4, 0, 0, 1, "again", "s.html", 1, "")]
    got = sources.walk_toc(spark.createDataFrame(two, schema).repartition(3)).collect()
    want = sorted(sources.toc_rows(script))
    for toc in (1, 2):
        assert sorted(tuple(r)[1:] for r in got if r["toc"] == toc) == want
    assert not any(r["toc"] == 3 for r in got) and any(r["toc"] == 4 for r in got)  # a ring hangs on no root; a node below itself ends
    assert sources.walk_toc(spark.createDataFrame([], schema)).count() == 0


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.html").write_text(PAGE, encoding="utf-8")
    (d / "sub" / "b.html").write_text(PAGE, encoding="utf-8")
    (d / "foo_open.html").write_text(PAGE, encoding="utf-8")
    pages = sources.read_html(spark, str(d))
    assert {r.source_file for r in pages.collect()} == {"a.html", "b.html"}
    assert sources.read_html(spark, str(d), 1).count() == 1
    chunks = build_corpus(pages)
    sources.write_chunks(chunks, str(tmp_path / "c"))
    back = sources.read_chunks(spark, str(tmp_path / "c"))
    assert back.count() == chunks.count() > 0
    sources.write_csv(chunks, str(tmp_path / "csv"))
    cleaned = clean_corpus(back.withColumn("ord", F.monotonically_increasing_id()), ["nowhere"])
    assert cleaned.count() == 1 and cleaned.first()["alt_sources"] != ""
    stream = append_new(chunk_stream(spark, str(tmp_path / "c")), str(tmp_path / "t"), str(tmp_path / "k"))
    stream.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == back.select("id").distinct().count()
    (tmp_path / "q.txt").write_text(" one \n\ntwo\n")
    assert [tuple(r) for r in sources.read_queries(spark, str(tmp_path / "q.txt")).collect()] == [(0, "one"), (1, "two")]
    notes = {"queries": ["x"], "annotations": {"q0_d1": {"query_idx": 0, "doc_idx": 1, "label": "partial"}, "q0_d0": {"query_idx": 0, "doc_idx": 0, "label": "relevant"}}}
    (tmp_path / "n.json").write_text(json.dumps(notes))
    assert [r.label for r in sources.read_annotations(spark, str(tmp_path / "n.json")).orderBy("rank").collect()] == ["relevant", "partial"]
    result = {"metrics": {n: {"P@3": 0.1, "P@5": 0.2, "NDCG@5": 0.3, "MRR": 0.5} for n in ("one", "two")}}
    (tmp_path / "r.json").write_text(json.dumps(result))
    assert sources.best_config(sources.read_ablation(spark, str(tmp_path / "r.json")), "MRR").first()["best"] == "one"
    (tmp_path / "bad.json").write_text('{"one": {"P@3": 1}}')
    with pytest.raises(ValueError):
        sources.read_ablation(spark, str(tmp_path / "bad.json"))


def test_latest(spark):
    df = spark.createDataFrame([("k", "1", "a"), ("k", "2", "b")], "key string, timestamp string, label string")
    assert latest(df).first()["label"] == "b"


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("retrieval:\n  top_k: 7\n  unknown: 1\n")
    e = load(str(tmp_path / "c.yaml"), {"QUILL_TOP_K_FINAL": "3", "QUILL_RERANK": "off"})
    assert (e.retrieval.top_k, e.retrieval.top_k_final, e.rerank.enabled) == (7, 3, False)


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_partitions_do_not_matter(spark, parts):
    docs = spark.createDataFrame([(i, f"w{i % 5}xx common token{i % 3}", f"s{i % 4}") for i in range(40)], "doc_id long, text string, source string").repartition(parts)
    q = spark.createDataFrame([(1, "w3xx token1 common")], "query_id long, text string")
    got = [(r.doc, r.score) for r in lexical.search(lexical.build(docs), q, 5).orderBy("rank").collect()]
    assert [d for d, _ in got] == [13, 28, 3, 8, 18]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_numbering_by_ranges(spark, parts):
    """A group that holds most rows, a group of its own, and null as a group: places as in one sorted list."""
    rows = [(("hot", "cold", None)[0 if i % 9 else i % 3], i * 3 % 101) for i in range(100)]
    got = corpus.numbered(spark.createDataFrame(rows, "g string, o int").repartition(parts), "g", "o", "at").collect()
    want = [(g, o, sum(h == g and p < o for h, p in rows)) for g, o in rows]
    assert sorted(map(repr, ((r["g"], r["o"], r["at"]) for r in got))) == sorted(map(repr, want))


def test_numbering_of_nothing(spark):
    assert corpus.numbered(spark.createDataFrame([], "g string, o int"), "g", "o", "at").count() == 0


def test_junk_of_null_pages(spark):
    rows = [(None, "a fine text of one page", 23), ("p", "another fine text here", 22), ("p", "and a third one of it", 21)]
    d = spark.createDataFrame(rows, "source_file string, text string, char_count int").withColumns({"has_table": F.lit(False), "has_procedure": F.lit(False)})
    assert [r["source_file"] for r in corpus.without_junk(d).collect()] == [None]


def test_search_plan(spark):
    """Postings are made without a grouping by term and document, and each task keeps the k best."""
    docs, asked = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    found = lexical.search(lexical.build(docs), asked.withColumnRenamed("item_id", "query_id"), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("WindowGroupLimit" in x for x in plan)
    assert any("LeftSemi" in x for x in plan) and any("Generate inline" in x for x in plan)
    assert not any("Aggregate [term" in x and "doc#" in x for x in plan)


def test_labels(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_idx int, source_file string, rank int")
    known = spark.createDataFrame([(1, "a", 0, "partial"), (1, "a", 1, "relevant")], "query_idx int, source_file string, doc_idx int, label string")
    judged = spark.createDataFrame([(1, "b", "partial")], "query_idx int, source_file string, label string")
    got = {r["source_file"]: r["label"] for r in evaluate.labelled(found, known, judged=judged).collect()}
    assert got == {"a": "relevant", "b": "partial", "c": "irrelevant"}
    every = evaluate.padded(spark.createDataFrame([(1, 2, "relevant")], "query_idx int, rank int, label string"), spark.createDataFrame([(1,), (2,)], "query_idx int"), 3)
    assert sorted(map(tuple, every.collect())) == [(1, 1, "irrelevant"), (1, 2, "relevant"), (1, 3, "irrelevant"), *[(2, i, "irrelevant") for i in (1, 2, 3)]]


def test_report(spark, tmp_path):
    labels = spark.createDataFrame([(2, 1, "relevant"), (1, 1, "irrelevant")], "query_idx int, rank int, label string")
    sources.write_report(evaluate.report(evaluate.query_metrics(labels)), str(tmp_path / "r"))
    read = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert read["n_queries"] == 2 and [x["query_idx"] for x in read["per_query"]] == [1, 2] and read["summary"]["mrr_strict"] == 0.5


def test_places_of_pages(spark):
    pages = spark.createDataFrame([("a.html", "text"), ("b.html", "> **Путь:** x"), ("c.html", "text")], "source_file string, markdown string")
    toc = spark.createDataFrame([("a.html", "A → B"), ("b.html", "A")], "source_file string, breadcrumbs string")
    got = {r["source_file"]: r["markdown"] for r in sources.located(pages, toc).collect()}
    assert got == {"a.html": "> **Раздел:** A → B\n\ntext", "b.html": "> **Путь:** x", "c.html": "text"}


def test_unanswered(spark):
    asked = spark.createDataFrame([(1, "q")], "query_id int, text string")
    none = spark.createDataFrame([], "query_id int, rank int, text string, source_file string, page_title string, section_path string, breadcrumbs string")
    assert query.answered(asked, none, product="P").first()["answer"] == query.NOTHING_FOUND.format(product="P")


def test_last_place_in_a_table_of_contents(spark):
    """Of a file's places the last by number counts, not the greatest as text."""
    pages = spark.createDataFrame([("a",), ("b",)], "source_file string")
    toc = spark.createDataFrame([("a", 9, "Page 9", "Help → Page 9"), ("a", 10, "Page 10", "Help → Page 10")], "source_file string, at int, title string, breadcrumbs string")
    got = {r["source_file"]: (r["toc_title"], r["toc_breadcrumbs"]) for r in chunking.with_toc(pages, toc, "at").collect()}
    assert got == {"a": ("Page 10", "Help → Page 10"), "b": (None, None)}
    assert {r["toc_title"] for r in chunking.with_toc(pages, toc).collect()} == {"Page 9", None}


def test_rules_of_markdown_begin_with_what_is_rare(spark):
    """The rules that were rewritten do what their plain forms do, in Spark and in Python, and are not tried at every character."""
    import regex

    s, w = X.SPACE, "[а-яА-ЯёЁa-zA-Z0-9]"
    plain = [
        (rf"(?<!{s})(?<!^){s}+\*\*", "**"), (rf"({w}|[,.])\*\*({w})", r"\1 **\2"), (rf"({w})\*\*([а-яА-ЯёЁa-zA-Z(])", r"\1** \2"),
        (rf"(?<!{s})(?<!^) {{2,}}(?!{s})(?!$)", " "), (rf"\*\*([^*]+)\*\*{s}*\*\*([^*]+)\*\*", r"**\1 \2**"),
    ]
    fast = [X.PAGE_RULES[7], X.PAGE_RULES[9], X.PAGE_RULES[10], X.INNER_BLANKS, X.ADJACENT_BOLD]
    rng = random.Random(5)
    pick = lambda: rng.choice(["**", "*", " ", "  ", "\n", "\t", "a", "ж", ".", "(", "9", " ", "\x85", "é", "🐈", "a**b**"])
    texts = ["".join(pick() for _ in range(rng.randrange(14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[X.ruled(F.col("t"), [r]) for r in plain + fast], X.trimmed(F.col("t"))).collect()
    for r in rows:
        want = tuple(regex.sub(p, to, r[0]) for p, to in plain)
        assert tuple(r[1:6]) == tuple(r[6:11]) == tuple(regex.sub(p, to, r[0]) for p, to in fast) == want, r[0]
        assert r[11] == r[0].strip(X.SPACES)
    assert {c for c in map(chr, range(0x10000)) if regex.fullmatch(s, c)} == set(X.SPACES)
    assert not any(p.startswith(("([", "(?<")) for p, _ in X.PAGE_RULES)


def test_pages_in_slices(spark):
    """Results of many pages are handed on some pages at a time, and none is lost; null pages and texts are kept."""
    import pyarrow as pa

    parts = [b.column(0).to_pylist() for b in chunking._slices(iter([pa.RecordBatch.from_pydict({"x": list(range(300))})] * 2))]
    assert max(map(len, parts)) == chunking.SLICE and sum(parts, []) == [*range(300)] * 2
    n = 2 * chunking.SLICE + 1
    pages = spark.range(n).coalesce(1).selectExpr("concat('p', id) AS source_file").withColumn("html", F.when(F.col("source_file") != "p3", PAGE))
    assert chunking.blocks(pages).select("source_file").distinct().count() == n - 1
    assert chunking.page_results(pages).count() == n and chunking.markdown(pages).where("markdown is not null").count() == n - 1
    got = chunking.pack_lines(pages.select("source_file", F.when(F.col("html").isNotNull(), "a\nb").alias("text"))).collect()
    assert {r["source_file"]: r["parts"] for r in got} == {f"p{i}": ["a\nb"] if i != 3 else [""] for i in range(n)}


def test_walk_without_broadcast(spark):
    """Nothing that grows with the tables of contents is collected on the driver."""
    nodes = spark.createDataFrame([("t", 1, None, 0, "A", "a", 0, ""), ("t", 2, 1, 0, "B", "b", 1, "")], "toc string, node int, parent int, position int, title string, source_file string, level int, topic_type string")
    got = sources.walk_toc(nodes)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and "MERGE" in sources.WALK
    assert sorted((r["source_file"], r["breadcrumbs"], r["has_children"]) for r in got.collect()) == [("a", "A", True), ("b", "A → B", False)]
