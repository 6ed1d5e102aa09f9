"""Collections, their indexes, assembly, and the models around them."""

import json
import random
import sys
import threading
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import plans, sources
from quillspark.config import Embedding, Engine, Language, Rerank
from quillspark.functions import text as X
from quillspark.operators import answers, blockmax, chunking, evaluate, ivf, lexical, models, query, store, vector
from quillspark.operators.html import Options
from quillspark.plans import Retriever, ablate_saved, ablation_grid, assemble, ingest, with_judged


def rows_of(spark, ids, dim=4, text="text of {}"):
    rng = np.random.default_rng(1)
    space = rng.normal(size=(100, dim))
    return spark.createDataFrame([(f"c{i:03}", text.format(i), f"f{i % 3}", space[i].tolist()) for i in ids], "chunk_id string, page_content string, source_file string, embedding array<double>")


def ids(collection):
    return sorted(r["chunk_id"] for r in collection.scan().collect())


@pytest.mark.parametrize("approximate", [False, True])
def test_adding_twice_keeps_one_of_each(spark, tmp_path, approximate):
    c = store.Collection(spark, str(tmp_path / "c"))
    assert not c.exists() and c.count() == 0 and c.state() is None
    c.add(rows_of(spark, range(5)).unionByName(rows_of(spark, [2, 2])), None, approximate=approximate)
    c.add(rows_of(spark, range(3, 8), text="other text of {}"), None, approximate=approximate)
    assert c.count() == 8 and ids(c) == [f"c{i:03}" for i in range(8)]
    docs = {r["chunk_id"]: r for r in c.scan().collect()}
    assert docs["c003"]["page_content"] == "text of 3" and docs["c007"]["page_content"] == "other text of 7"  # the first stays
    assert sorted(r["doc"] for r in docs.values()) == list(range(8))
    asked = spark.createDataFrame([(1, docs["c004"]["embedding"])], "query_id long, embedding array<double>")
    found = c.search(asked, 2).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [0, 1] and found[0]["chunk_id"] == "c004" and len({r["chunk_id"] for r in found}) == 2
    assert c.search(asked, 8, threshold=found[1]["score"]).count() == 2
    index = lexical.load(spark, c.lexical(), c.count())
    assert {r["doc"] for r in lexical.search(index, spark.createDataFrame([(1, "other")], "query_id long, text string"), 5).collect()} == {docs[f"c{i:03}"]["doc"] for i in (5, 6, 7)}


@pytest.mark.parametrize("breaks", ["build", "_commit"])
def test_a_broken_addition_changes_nothing(spark, tmp_path, monkeypatch, breaks):
    c = store.Collection(spark, str(tmp_path / "c"))
    c.add(rows_of(spark, range(4)), None)

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.lexical if breaks == "build" else store.Collection, breaks, lost)
        with pytest.raises(RuntimeError):
            c.add(rows_of(spark, range(2, 9)), None)
    assert ids(c) == [f"c{i:03}" for i in range(4)] and lexical.load(spark, c.lexical(), 4).totals.first()["n_docs"] == 4
    c.add(rows_of(spark, range(4, 6)), None)
    assert ids(c) == [f"c{i:03}" for i in range(6)] and sorted(r["doc"] for r in c.scan().collect()) == list(range(6))


def test_reset_is_one_step(spark, tmp_path, monkeypatch):
    c = store.Collection(spark, str(tmp_path / "c"))
    c.add(rows_of(spark, range(4)), None)
    with monkeypatch.context() as m:
        m.setattr(store.Collection, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            c.add(rows_of(spark, [50]), None, reset=True)
    assert c.count() == 4
    c.add(rows_of(spark, [50, 51]), None, reset=True)
    assert ids(c) == ["c050", "c051"] and c.count() == 2
    c.prune()
    assert ids(c) == ["c050", "c051"] and {p.name for p in (tmp_path / "c" / "docs").iterdir()} == {"batch=1"} and {p.name for p in (tmp_path / "c" / "lexical").iterdir()} == {"1"}


def test_tables_on_the_way_are_deleted(spark):
    from pathlib import Path

    from quillspark.session import discarding, saved

    outside = saved(spark.range(3))
    with discarding(spark):
        inside = saved(spark.range(5))
        files = [f.removeprefix("file://") for f in inside.inputFiles()]
        assert inside.count() == 5 and all(Path(f).exists() for f in files)
    assert not any(Path(f).exists() for f in files) and outside.count() == 3


def test_unknown_backend(spark):
    with pytest.raises(store.Backend):
        store.open_collection(spark, store.Settings(backend="other"))


# whole assembly


def chunk_rows(spark, ids):
    rows = [(f"id{i}", f"word{i} common text about {'apples' if i % 2 else 'pears'} number {i}", f"f{i % 4}.html", f"Title {i % 4}", "", "", "", ["PARAGRAPH"], False, False, False, i, 40, 10, i) for i in ids]
    return spark.createDataFrame(rows, "id string, text string, source_file string, page_title string, breadcrumbs string, section_title string, section_path string, block_types array<string>, has_table boolean, has_image boolean, has_procedure boolean, chunk_index int, char_count int, token_count_approx int, ord long")


@pytest.fixture
def engine(tmp_path):
    e = Engine()
    e.store.path, e.retrieval.index_path, e.embedding.model, e.rerank.model = str(tmp_path / "store"), str(tmp_path / "bm25"), "hashing", "overlap"
    return e


def chat():
    return lambda messages: "- apples and more" if "- " in messages[-1]["content"] and "Правила" in messages[-1]["content"] else "An answer [1]"


def test_ingest_again_and_assemble(spark, engine):
    with pytest.raises(plans.NotReady):
        assemble(spark, engine)
    with pytest.raises(plans.NotReady):
        ingest(chunk_rows(spark, []), engine)
    assert ingest(chunk_rows(spark, range(6)), engine).count() == 6
    ingest(chunk_rows(spark, range(3, 9)), engine)
    p = assemble(spark, engine, make_chat=chat)
    assert p.collection.count() == 9
    asked = spark.createDataFrame([(1, "word7 apples"), (2, "word2 pears")], "query_id long, text string")
    got = {r["query_id"]: r for r in p.ask(asked).collect()}
    assert "[[1]]" in got[1]["answer"] or "Источники" in got[1]["answer"]
    assert got[1]["rag_time"] >= 0 and got[1]["error"] is None and any("f3" in s["source_file"] for s in got[1]["sources"])
    ingest(chunk_rows(spark, [20]), engine, reset=True, approximate=True)
    assert assemble(spark, engine, make_chat=chat).collection.count() == 1
    judged = assemble(spark, engine, make_chat=chat).judge(asked, lambda: lambda m: json.dumps({c: {"score": "yes", "reason": ""} for c in evaluate.CRITERIA}))
    assert {"rag_time", "judgment"} <= set(judged.columns) and judged.count() == 2


def test_lexical_only(spark, engine):
    ingest(chunk_rows(spark, range(4)), engine, lexical_only=True)
    assert lexical.load(spark, engine.retrieval.index_path, 4).totals.first()["n_docs"] == 4
    with pytest.raises(ValueError):
        lexical.load(spark, engine.retrieval.index_path, 5)
    with pytest.raises(plans.NotReady):  # no collection was made
        assemble(spark, engine)


def test_filtered_retrieval(spark):
    docs = spark.createDataFrame([(i, f"f{i}", 0, ("apple " if i < 5 else "pear ") * (i + 1)) for i in range(15)], "doc long, source_file string, chunk_index int, text string")
    r = Retriever(docs, lexical.build(docs, "doc"), spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "doc long, embedding array<double>"))
    asked = spark.createDataFrame([(1, 0, "apple", [1.0, 0.0])], "query_id long, list_idx int, text string, embedding array<double>")
    only = F.col("source_file").isin("f1", "f2")
    assert [x["doc"] for x in r.ranked(asked, "vector", 2, only).orderBy("rank").collect()] == [2, 1]  # before the two best are taken
    assert r.ranked(asked, "bm25", 5, only).count() == 5 and r.ranked(asked, "bm25", 5, only, True).count() == 2


# pruned BM25


@pytest.mark.parametrize("seed,docs,words", [(1, 300, 60), (2, 700, 8), (3, 40, 5), (4, 3, 2)])
def test_pruned_equals_plain(spark, tmp_path, seed, docs, words):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(words)]
    skewed = lambda: vocabulary[min(int(rng.expovariate(6 / words)), words - 1)]
    texts = [(i * 7 - 50, " ".join(skewed() for _ in range(rng.randrange(0, 60)))) for i in range(docs)] + [(10**15, None), (-(10**15), "")]
    texts += [(20_000 + i, texts[min(5, docs - 1)][1]) for i in range(30)]  # ties
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    index = lexical.build(documents).saved(str(tmp_path / "i"))
    asked = [(i, " ".join(skewed() for _ in range(rng.randrange(1, 6)))) for i in range(25)] + [(90, None), (91, "unheard")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for block in (1, 16):
        blockmax.save(documents, str(tmp_path / f"b{block}"), block)
        for k in (1, 10):
            got = blockmax.search(blockmax.load(spark, str(tmp_path / f"b{block}")), queries, k)
            assert sorted(map(tuple, got.found.collect())) == sorted(map(tuple, lexical.search(index, queries, k).collect()))
            scored, postings = got.read().first()
            assert 0 <= scored <= postings
    assert blockmax.search(blockmax.load(spark, str(tmp_path / "b16")), queries.where("false"), 3).found.count() == 0


def test_common_terms_are_skipped(spark, tmp_path):
    """A rare term beside one that every document has: most blocks are never opened."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.when(F.col("id") % 400 == 0, "rare rare").otherwise("other"), F.lit(" filler"), F.repeat(F.lit(" more"), (F.col("id") % 50).cast("int"))).alias("text"))
    index = lexical.build(docs).saved(str(tmp_path / "i"))
    blockmax.save(docs, str(tmp_path / "b"))
    asked = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    got = blockmax.search(blockmax.load(spark, str(tmp_path / "b")), asked, 10)
    assert sorted(map(tuple, got.found.collect())) == sorted(map(tuple, lexical.search(index, asked, 10).collect()))
    scored, postings = got.read().first()
    assert scored < 0.1 * postings


def shuffled(spark):
    """Bytes that this session has shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    return sum(e.totalShuffleWrite() for e in [spark.sparkContext._jsc.sc().statusStore().executorSummary("driver")])


def test_pruned_index_does_not_shuffle_documents(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, " ".join(f"word{rng.randrange(400)}" for _ in range(150))) for i in range(4000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8).localCheckpoint()
    before = shuffled(spark)
    blockmax.save(docs, str(tmp_path / "b"))
    assert shuffled(spark) - before < 0.1 * sum(len(t) for _, t in texts)


def test_pruned_with_other_ids_and_lost_heads(spark, tmp_path):
    """Ids that are strings or repeated, and blocks that begin in another task."""
    rng = random.Random(6)
    texts = [(i, " ".join(f"word{int(rng.expovariate(0.2))}" for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    whole = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"word{i} word{i * 7 % 20} word30") for i in range(12)], "query_id long, text string")
    for name, docs in (("text", whole.withColumn("doc_id", F.format_string("d%03d", "doc_id"))), ("twice", whole.withColumn("doc_id", F.col("doc_id") % 100))):
        blockmax.save(docs, str(tmp_path / name))
        got = blockmax.search(blockmax.load(spark, str(tmp_path / name)), asked, 5)
        assert sorted(map(tuple, got.found.collect())) == sorted(map(tuple, lexical.search(lexical.build(docs), asked, 5).collect()))
    blockmax.save(whole, str(tmp_path / "b"), 4)
    blocks = blockmax.load(spark, str(tmp_path / "b"))
    lost = F.pmod(F.xxhash64("block"), F.lit(2)) == 0
    blocks.index.packed = blocks.index.packed.withColumns({c: F.when(~lost, F.col(c)) for c in ("heads", "most")})
    got = blockmax.search(blocks, asked, 5)
    assert sorted(map(tuple, got.found.collect())) == sorted(map(tuple, lexical.search(lexical.build(whole), asked, 5).collect()))


def test_an_addition_counts_its_own_documents_only(spark, tmp_path, monkeypatch):
    """The second batch tokenises what it adds; searches find what an index made at once finds."""
    c, seen, build = store.Collection(spark, str(tmp_path / "c")), [], lexical.build

    def counted(docs, *args):
        seen.append(docs.count())
        return build(docs, *args)

    monkeypatch.setattr(lexical, "build", counted)
    c.add(rows_of(spark, range(40), text="number{0} common text of {0}"), None)
    c.add(rows_of(spark, range(30, 50), text="number{0} common text of {0}"), None)
    assert seen == [40, 10]
    asked = spark.createDataFrame([(1, "number7 common"), (2, "number7 number41 number35")], "query_id long, text string")
    plain = sorted(map(tuple, lexical.search(build(c.scan(), "doc", "page_content"), asked, 5).collect()))
    assert plain == sorted(map(tuple, lexical.search(lexical.load(spark, c.lexical(), 50), asked, 5).collect()))
    assert plain == sorted(map(tuple, blockmax.search(blockmax.load(spark, c.lexical()), asked, 5).found.collect()))


# index of vectors


def clustered(spark, n=20_000, dim=16, seed=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(400, dim))
    which = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 400, n))  # one cluster holds a third
    x = centres[which] + 0.25 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")


def recall(got, want):
    found, best = {}, {}
    for part, rows in ((found, got), (best, want)):
        for r in rows.collect():
            part.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(found.get(q, set()) & near) / len(near) for q, near in best.items()])


def test_index_of_vectors_in_clusters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK_VECTORS", 2000)  # the hot cell is dealt over blocks
    vectors = clustered(spark)
    made = ivf.build(vectors, str(tmp_path / "i"))
    again = ivf.load(spark, str(tmp_path / "i"))
    assert again.model.probes == made.model.probes and np.array_equal(again.model.centroids, made.model.centroids) and all(map(np.array_equal, again.model.books, made.model.books))
    queries = vectors.where("vec_id % 200 = 0").withColumnRenamed("vec_id", "query_id")
    got = again.search(queries, 10)
    assert recall(got, vector.topk(vectors, queries, 10)) >= 0.95 and made.model.share < 0.2
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in vector.topk(vectors, queries, 200).collect()}
    assert all(exact.get((r["query_id"], r["vec_id"]), r["score"]) == r["score"] for r in got.collect())
    # one query reads less than a tenth of the files
    one = queries.where("query_id = 400")
    cells = [r["cell"] for r in again.probed(one).select("cell").distinct().collect()]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(again.vectors().where(F.col("cell").isin(cells))) < 0.1 * files(again.vectors())
    again.add(spark.createDataFrame([(99_999, queries.where("query_id = 400").first()["embedding"])], "vec_id long, embedding array<double>"))
    assert {r["vec_id"] for r in again.search(one, 2).collect()} == {400, 99_999}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_index_of_vectors_recall(spark, tmp_path, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    made = ivf.build(vectors, str(tmp_path / "i"))
    assert recall(made.search(queries, 10), vector.topk(vectors, queries, 10)) >= 0.95 and made.model.share < 1


def test_index_of_few_vectors(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    made = ivf.build(vectors, str(tmp_path / "i"))
    got = made.search(vectors.where("vec_id < 3").withColumnRenamed("vec_id", "query_id"), 2).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} >= {(1, 0, 1), (1, 1, 3), (2, 0, 2)}
    with pytest.raises(ValueError):
        ivf.build(vectors.where("false"), str(tmp_path / "n"))


# scoring pairs in batches


def test_pairs_are_scored_in_batches(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def make():
        import os
        import uuid

        base = models.overlap_scorer()
        (log / f"made-{os.getpid()}-{uuid.uuid4().hex}").touch()

        def score(pairs):
            assert len(pairs) <= 5
            lengths = [len(q) + len(t) for q, t in pairs]
            assert lengths == sorted(lengths) and max(len(t) for _, t in pairs) <= 40
            return base(pairs)

        return score

    rng = random.Random(3)
    words = "red green blue apple pear plum stone".split()
    rows = [(i % 6, i // 6, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(120)] + [(7, 0, None, "red"), (7, 1, "red", None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, question string, text string").repartition(4)
    got = query.scored(df, f"test-{log}", make, 5, 10).collect()
    plain = models.overlap_scorer()
    assert len(got) == 122 and all(r["logit"] == plain([(r["question"] or "", (r["text"] or "")[:40])])[0] for r in got)
    processes = [p.name.split("-")[1] for p in log.iterdir()]
    assert len(processes) == len(set(processes))  # one model a process
    want = query.rerank(df, query.overlap_logit(F.col("question"), query.clipped(F.col("text"), 10)), 4).orderBy("query_id", "rank")
    best = query.rerank(query.scored(df, f"test-{log}", make, 5, 10), F.col("logit"), 4).orderBy("query_id", "rank")
    key = lambda d: [(r["query_id"], r["rank"], r["text"], r["reranker_score"]) for r in d.collect()]
    assert key(best.where("query_id < 6")) == key(want.where("query_id < 6"))


def test_scores_are_shown_at_four_digits_and_ordered_by_all(spark):
    df = spark.createDataFrame([(1, 0, 1.00001), (1, 1, 1.00002), (1, 2, 1.00002)], "query_id long, rank int, l double")
    got = query.rerank(df, F.col("l"), 3).orderBy("rank").collect()
    assert [r["l"] for r in got] == [1.00002, 1.00002, 1.00001] and {r["reranker_score"] for r in got} == {0.7311}


def test_scorers(monkeypatch):
    class CrossEncoder:
        def __init__(self, name, max_length):
            self.made = (name, max_length)

        def predict(self, pairs, batch_size, activation_fn):
            return [activation_fn(float(len(t))) for _, t in pairs]

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(CrossEncoder=CrossEncoder))
    assert models.scorer(Rerank(model="any"))()([("q", "abc")]) == [3.0]
    models.register_scorer("mine", lambda config: lambda pairs: [config.batch] * len(pairs))
    assert models.scorer(Rerank(model="mine", batch=9))()([("q", "t")]) == [9]


# models


def test_embedders(monkeypatch):
    made = []

    class SentenceTransformer:
        def __init__(self, name, device=None, **more):
            made.append((name, more))

        def encode(self, texts, batch_size, normalize_embeddings):
            return texts

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=SentenceTransformer))
    e5 = Embedding(model="x/e5-instruct", task="Find it")
    assert models.embedder(e5)(["a"]) == ["a"] and models.embedder(e5, query=True)(["a"]) == ["Instruct: Find it\nQuery: a"]
    assert models.embedder(Embedding(model="other"), query=True)(["a"]) == ["a"]
    assert made[0] == ("x/e5-instruct", {}) and made[-1] == ("other", {"model_kwargs": {"torch_dtype": "float16"}})


def test_chat_request():
    body = models.chat_request(Language(model="m", temperature=0.1, max_tokens=5, top_p=0.9, disable_thinking=True), [{"role": "user", "content": "x"}])
    assert (body["model"], body["temperature"], body["max_tokens"], body["top_p"]) == ("m", 0.1, 5, 0.9) and body["chat_template_kwargs"] == {"enable_thinking": False}
    assert not {"top_p", "chat_template_kwargs"} & set(models.chat_request(Language(disable_thinking=False), []))


def test_retried(monkeypatch):
    waits, left = [], [ValueError("a"), ValueError("b"), "fine"]
    monkeypatch.setattr(models.time, "sleep", waits.append)

    def ask():
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert models.retried(ask, 5, 2.0) == "fine" and waits == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        models.retried(lambda: 1 / 0, 2, 0.0)


def test_replies_in_flight(spark):
    def make():
        busy, most, lock = [0], [0], threading.Lock()

        def reply(messages):
            import time

            with lock:
                busy[0] += 1
                most[0] = max(most[0], busy[0])
            time.sleep(0.05)
            with lock:
                busy[0] -= 1
            if messages[0]["content"] == "3":
                raise ValueError("three")
            return f"{messages[0]['content']}:{most[0]}"

        return reply

    rows = spark.range(9).coalesce(1)
    got = models.replies(rows, lambda r: [{"content": str(r["id"])}] if r["id"] != 5 else [], make, seconds="took", in_flight=3).collect()
    by = {r["id"]: r for r in got}
    assert [r["id"] for r in got] == list(range(9)) and by[3]["error"] == "three" and by[3]["reply"] is None
    assert by[5]["reply"] is None and by[5]["error"] is None and by[5]["took"] == 0 and by[1]["took"] > 0.04
    assert max(int(r["reply"].split(":")[1]) for r in got if r["reply"]) == 3
    assert models.replies(rows.where("id < 0"), lambda r: [], make, seconds="took").count() == 0


def test_judged_labels_show_the_best_chunk(spark):
    rows = spark.createDataFrame([(1, "q", "f", 4, "late"), (1, "q", "f", 0, "first"), (1, "q", "g", 2, "never")], "query_idx long, question string, source_file string, rank int, text string")
    truth = spark.createDataFrame([(1, "h", 6, "relevant")], "query_idx long, source_file string, doc_idx long, label string")

    def make():
        tries = {}

        def reply(messages):
            asked = messages[-1]["content"]
            tries[asked] = tries.get(asked, 0) + 1
            if "never" in asked or tries[asked] < 3:
                return "no JSON"
            return json.dumps({"label": "partial" if "first" in asked else "relevant"})

        return reply

    got = {(r["source_file"], r["doc_idx"], r["label"]) for r in with_judged(rows, truth, make, attempts=3, wait=0.0).collect()}
    assert got == {("h", 6, "relevant"), ("f", 7, "partial"), ("g", 8, "irrelevant")}


def test_judgments_are_read_strictly(spark):
    good = '{"relevance": {"score": "yes", "reason": "r"}, "overall": 3, "list": [1]}'
    texts = [good, "```json\n" + good + "\n```", good + " done", good + ', "end": 1', "[1]", "", "{", '{"relevance": {"score": "no"}}}', None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(evaluate.judgment(F.col("t"))).collect()]
    assert all(j["relevance"]["score"] == "yes" and set(j) == {"relevance", "overall", "list"} and j["overall"]["score"] is None for j in got[:2])
    assert all(set(j) == set(evaluate.CRITERIA) and j["relevance"]["score"] == "error" for j in got[2:])
    assert got[2]["relevance"]["reason"] == (good + " done")[:200]


def test_rewrite_prompt_has_three_examples():
    text = query.rewrite_prompt("why?", "P")[0]["content"]
    assert text.count('Вопрос: "') == 4 and "{product}" not in text and "системные требования P" in text and text.endswith('Вопрос: "why?"\n')


def test_generation_report(spark):
    judged = evaluate.judgment(F.lit(json.dumps({c: {"score": "yes", "reason": "r"} for c in evaluate.CRITERIA})))
    e = spark.createDataFrame([(2, "q2", "a", 1, 0.5), (1, "q1", 'say "x}"', 0, None)], "idx long, question string, answer string, n_docs long, rag_time double").withColumn("judgment", judged)
    stats = answers.evaluated(e)
    lines = [json.loads(r["report"]) for r in evaluate.generation_report(e, stats, "m", "now").orderBy("idx").collect()]
    assert lines[0]["n_queries"] == 2 and lines[0]["stats"]["overall"] == 1.0 and lines[2]["rag_time"] == 0.5
    one = evaluate.generation_report(e, stats, "m", "now", single=True).collect()
    whole = json.loads(one[0]["report"])
    assert len(one) == 1 and whole["model_judge"] == "m" and [x["question"] for x in whole["evaluations"]] == ["q1", "q2"] and whole["evaluations"][0]["answer"] == 'say "x}"'


# resumable ablation


def test_ablation_goes_on_where_it_broke(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"f{i % 3}", 0, f"apple word{i}") for i in range(9)], "doc long, source_file string, chunk_index int, text string")
    r = Retriever(docs, lexical.build(docs, "doc"), spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(9)], "doc long, embedding array<double>"))
    asked = spark.createDataFrame([(1, 0, "apple word3", [1.0, 0.0]), (2, 0, "word5", [0.0, 1.0])], "query_id long, list_idx int, text string, embedding array<double>")
    truth = spark.createDataFrame([(1, "f0", 0, "relevant"), (2, "f2", 0, "partial")], "query_idx long, source_file string, doc_idx long, label string")
    args = (r, asked, asked, truth, query.overlap_logit(F.col("question"), F.col("text")))
    path, names = str(tmp_path / "a"), [g[0] for g in ablation_grid()]
    write, left = type(docs.write).parquet, [4]

    def breaking(self, target, *a, **kw):
        if target.startswith(path):
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("lost")
        return write(self, target, *a, **kw)

    with monkeypatch.context() as m:
        m.setattr(type(docs.write), "parquet", breaking)
        with pytest.raises(RuntimeError):
            ablate_saved(path, *args)
    done = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert done == sorted(names[:4])
    (tmp_path / "a" / names[4] / "_temporary").mkdir(parents=True)  # a write that broke off
    before = {n: sorted(p.name for p in (tmp_path / "a" / n).glob("*.parquet")) for n in names[:4]}
    got = ablate_saved(path, *args)
    assert before == {n: sorted(p.name for p in (tmp_path / "a" / n).glob("*.parquet")) for n in names[:4]}
    assert [x["config"] for x in got.orderBy("ord").collect()] == names and all(x["avg_time"] > 0 for x in got.collect())
    key = lambda df: sorted((x["config"], x["ord"], x["P@3"], x["P@5"], x["NDCG@5"], x["MRR"]) for x in df.collect())
    assert key(got) == key(plans.ablate(*args))
    monkeypatch.setattr(Retriever, "ranked", lambda *a, **k: 1 / 0)  # all is there: nothing is searched
    assert key(ablate_saved(path, *args)) == key(got)


# pages and outputs


GOOD = '<p class="topictitle">T</p><div id="hmpagebody_scroller"><p class="p_bodytext">' + "Some words of a page. " * 20 + "</p></div>"


def test_a_bad_page_is_counted(spark, monkeypatch, tmp_path):
    pages = spark.createDataFrame([("good.html", GOOD), ("empty.html", "<p>no body</p>"), ("null.html", None), ("bad.html", GOOD.replace("</p></div>", '</p><table><tr><td colspan="99999999999">x</td></tr></table></div>'))], "source_file string, html string")
    results = plans.build_results(pages)
    by = {r["source_file"]: r for r in results.collect()}
    assert {f: r["status"] for f, r in by.items()} == {"good.html": "processed", "empty.html": "skipped", "null.html": "skipped", "bad.html": "error"}
    assert "columns" in by["bad.html"]["error"] and by["bad.html"]["chunks"] == []
    assert tuple(chunking.page_counters(results).first()) == (4, 1, 2, 1, 1)
    errors = {r["source_file"]: r["error"] for r in chunking.blocks(pages.where("html is not null")).collect()}
    assert errors["bad.html"] and not errors["good.html"]
    converted = chunking.markdown(pages)
    assert tuple(chunking.markdown_counters(converted).first()) == (4, 1, 2, 1)
    written = sources.write_markdown_files(converted.select(F.concat(F.lit("/in/sub/"), "source_file").alias("path"), "markdown"), "/in", str(tmp_path / "md"))
    assert {r["path"]: r["written"] for r in written.collect()}["/in/sub/good.html"] and [p.name for p in (tmp_path / "md" / "sub").iterdir()] == ["good.md"]


def test_a_wide_table_is_whole():
    from quillspark.operators import html as H

    _, _, blocks = H.page_blocks('<div id="hmpagebody_scroller"><table><tr><td colspan="1500">x</td></tr><tr><td>y</td></tr></table></div>')
    assert blocks[0][1].split("\n")[1].count("---") == 1500


def test_optional_drops():
    from quillspark.config import Chunking

    blocks = [("PARAGRAPH", "words " * 60, ""), ("SEE_ALSO", "see this", ""), ("COMMAND_INVOCATION", "run that", ""), ("IMAGE", "![i](x.png)", ""), ("FOOTER", "(c)", ""), ("PARAGRAPH", "  ", "")]
    made = lambda **kw: chunking.chunk_page("f", "T", "", blocks, Chunking(**kw))[0]
    all_ = made()
    assert all(x in all_["text"] for x in ("see this", "run that", "x.png")) and all_["has_image"] and "(c)" not in all_["text"]
    bare = made(see_also=False, command_invocation=False, images=False)
    assert not any(x in bare["text"] for x in ("see this", "run that", "x.png")) and not bare["has_image"] and bare["block_types"] == ["PARAGRAPH"]


def test_outputs(spark, tmp_path):
    chunks = chunk_rows(spark, range(12)).withColumn("text", F.repeat("text", 20))
    shown = sources.preview(chunks, 3, 100).collect()
    assert len(shown) == 3 and shown[0]["text"].startswith("word0 ") and "more chars)" in shown[0]["text"] and len(shown[0]["text"]) < 140
    assert set(sources.write_outputs(chunks, single=True)) == {"preview", "statistics", "types", "sizes"}
    jsonl, csv = str(tmp_path / "j"), str(tmp_path / "c")
    assert sources.write_outputs(chunks, jsonl, csv) == {} and set(sources.write_outputs(chunks, jsonl, stats=True, show=True)) == {"preview", "statistics", "types", "sizes"}
    assert sources.read_chunks(spark, jsonl).count() == 12 and spark.read.option("header", True).option("multiLine", True).csv(csv).count() == 12


def test_annotations_are_written_and_read(spark, tmp_path):
    notes = spark.createDataFrame([("q0_d1", 0, 1, "b", "partial"), ("q0_d0", 0, 0, "a", "relevant"), ("q1_d0", 1, 0, "c", "irrelevant")], "key string, query_idx int, doc_idx int, source_file string, label string")
    asked = spark.createDataFrame([(1, "two"), (0, "one")], "query_idx int, query string")
    sources.write_annotations(notes, asked, str(tmp_path / "a"), "now")
    assert sorted(map(tuple, sources.read_annotations(spark, str(tmp_path / "a")).collect())) == [(0, 1, "relevant", "a"), (0, 2, "partial", "b"), (1, 1, "irrelevant", "c")]
    assert [r["query"] for r in sources.read_annotated_queries(spark, str(tmp_path / "a")).orderBy("query_idx").collect()] == ["one", "two"]
    whole = json.loads(next((tmp_path / "a").glob("*.json")).read_text())
    assert whole["created"] == "now" and whole["stats"]["total"] == 3


def test_input_with_alternative_sources(spark):
    again = chunk_rows(spark, [1, 1]).withColumn("alt_sources", F.lit("old"))
    assert plans.clean_corpus(again).collect()[0]["alt_sources"] == "f1.html"


def test_single_page_read(spark, tmp_path):
    (tmp_path / "p.html").write_bytes(GOOD.encode())
    assert plans.build_corpus(sources.read_html(spark, str(tmp_path), 1), options=Options()).count() == 1
    assert spark.createDataFrame([("a b",)], "t string").select(X.tokens(F.col("t"))).first()[0] == []


@pytest.mark.parametrize("parts", [1, 7])
def test_saved_index_scores_documents_where_they_lie(spark, tmp_path, monkeypatch, parts):
    """Rows are those of the joins, with ties, small slices, empty texts and more than one list in a task; no hit is shuffled."""
    rows = [(i, f"common w{i % 7}xx w{i % 3}yy común м²и " + "often " * (i % 4)) for i in range(300)] + [(300, None), (301, "ab ..")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    asked = spark.createDataFrame([(1, "w3xx COMÚN often often"), (2, "w1yy w5xx М²И"), (3, "nothing"), (None, "w2xx")], "query_id long, text string")
    index = lexical.build(docs).saved(str(tmp_path / "i"))
    monkeypatch.setattr(lexical, "CELLS", 40)
    for k in (5, 400):
        got = lexical.search(index, asked, k)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan
        plain = lexical.search(lexical.build(docs), asked, k)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    assert {r["query_id"] for r in got.collect()} == {1, 2, None}


def test_saved_index_of_repeated_documents(spark, tmp_path):
    """Where a document is more than one row, its parts are summed before the best are taken."""
    docs = spark.createDataFrame([(1, "cat"), (1, "cat dog"), (2, "cat cat"), (3, "bird")] + [(i, "fish") for i in range(4, 9)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "cat")], "query_id long, text string")
    index = lexical.build(docs).saved(str(tmp_path / "i"))
    assert not index.unique
    assert lexical.search(index, asked, 1).first()["doc"] == 1
    assert sorted(map(tuple, lexical.search(index, asked, 5).collect())) == sorted(map(tuple, lexical.search(lexical.build(docs), asked, 5).collect()))
