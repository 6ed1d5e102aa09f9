"""The other operators: exact versions, round trips, held-out accuracy, awkward inputs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, language_id, learning, mixing, packing, quality_classifier, quality_rules, registry, token_counts, toxicity
from quillspark.llm.common import bucket_of, drawn

from ..oracle import compare

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(registry.SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    compare(registry.QUERIES[name](spark, f"/root/testdata/{sf}"), registry.SQL[name], f"/root/testdata/{sf}")


# quality rules


def test_repeat_words():
    rng = random.Random(1)
    for _ in range(100):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(40))]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        assert quality_rules.repeat_words(words) == len(hit)


def test_repeat_words_with_many_words():
    words = [str(i).encode() for i in range(30000)] + [str(i).encode() for i in range(7)]
    assert quality_rules.repeat_words(words) == 14


def test_rules_on_awkward_rows(nasty, nothing):
    got = quality_rules.judge(nasty).collect()
    assert len(got) == nasty.count()
    for r in got:
        d = quality_rules.base((r.text or "").encode())
        failed = quality_rules.base_failed(d)
        assert r["__rules"].n_words == len(d.words) and r["__rules"].base_failed == failed
        assert r["__rules"].kept == (not failed and not any(f(d) for f in quality_rules.RULES.values()))
        assert r["__rules"].word_chars == sum(len(w.decode()) for w in d.words)
    assert quality_rules.judge(nothing).count() == 0


def test_cascade_order():
    rules = dict.fromkeys(["slow", "fast", "never"])
    assert quality_rules.plan([("slow", 100.0, 0.5), ("fast", 1.0, 0.1), ("never", 1.0, 0.0)], rules) == ["fast", "slow", "never"]


# packing


def test_lengths():
    for n in [*range(1, 3000), 123457]:
        got = packing.lengths(n)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1024 for x in got) and got == sorted(got, reverse=True)


def test_packing_round_trip(nasty, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(nasty, with_ids=True).collect()
    sequences = {p.sequence_id for p in pieces}
    assert len(sequences) == len(pieces) and all(p.offset == 0 and p.length == len(p.ids) for p in pieces)
    assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
    got, want = Counter(), Counter()
    for p in pieces:
        got[(p.doc_id, p.start, tuple(p.ids))] += 1
    for r in nasty.collect():
        ids, at = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0], 0
        for n in packing.lengths(len(ids)):
            want[(r.doc_id, at, tuple(ids[at : at + n]))] += 1
            at += n
    assert got == want
    assert packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nasty, sequence=1000)


ODD = ["", " ", "  a  b", "\n\n x", "a\n\nb \n", "a▁b", "▁▁", "a\x00b", "<s>hi</s>", "x\r\ny; \r", "日本語 テスト", "ﬁ①", "a\xa0b", "\t\t", "é" * 50, "<0x0A>", "😀 a😀", "a" * 3000, "   " * 40, "<|endoftext|> a", "it's I'LL", "ªº²½ x³", "\x1c\x85 b"]


def test_other_vocabularies_go_through_the_library(tmp_path):
    import json

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.plain(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        assert not packing.plain(spec | change)
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    assert packing.encode("SOME Words", str(other)).tolist() == packing.encode("some words", path).tolist()


def test_encoding():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(0)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(1, 0x250), 32, 97, 39, 10, 0xA0, 0x85])) for _ in range(20)) for _ in range(500)]
    for t in texts:
        assert packing.encode(t, path).tolist() == whole.encode(t, add_special_tokens=False).ids


# token counts


def test_counts():
    use, rng = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model")), random.Random(0)
    assert use.cuts and len(use.whole) > 30000
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(0, 0x250), 32, 97, 39, 10, 13, 0x2581, 0x4E00])) for _ in range(20)) for _ in range(500)]
    assert [use.count(t) for t in texts] == [len(use.model.encode(t)) for t in texts]


def test_counts_of_awkward_rows(nasty, nothing):
    model = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model")).model
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in nasty.collect())
    assert Counter(map(tuple, token_counts.count_tokens(nasty).collect())) == want
    assert token_counts.count_tokens(nothing).count() == 0


# classifiers


def accuracy(got, truth):
    return np.mean([truth(r) for r in got])


def test_isotonic():
    x, y = learning.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_quality(spark):
    got = registry.op4(spark, SF).where("held_out").join(table(spark, "labels"), "doc_id").collect()
    assert accuracy(got, lambda r: r.predicted == r.quality) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op9(spark, sf).where("held_out").join(table(spark, "labels", sf), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.predicted for r in got) > 0.95 and hit / sum(r.toxic for r in got) > 0.85


def test_quality_against_dense_algebra(spark):
    """Partition sums and calibration equal one dense solution over the same rows."""
    docs, labels, learn = table(spark, "documents"), table(spark, "labels"), bucket_of("doc_id", 5) != 0
    model = quality_classifier.fit(docs, labels, learn, rows=200, features=32)
    sample = learning.labelled_sample(docs, labels, "quality", learn, 200)[0].withColumn("ridge", F.pmod(F.xxhash64("id"), F.lit(4)) != 0).collect()
    assert len(sample) == 200
    x = lambda kept: np.array([quality_classifier.statistics(r.text.encode()) for r in sample if r.ridge == kept])
    y = lambda kept: np.array([float(r.y) for r in sample if r.ridge == kept])
    a, n = x(True), y(True)
    rng = np.random.default_rng(quality_classifier.SEED)
    waves, phase = rng.normal(0, 1 / np.sqrt(a.shape[1]), (a.shape[1], 32)), rng.uniform(0, 2 * np.pi, 32)
    scale = np.sqrt(np.maximum(a.var(0), 1e-6))
    features = lambda z: np.c_[np.cos((z - a.mean(0)) / scale @ waves + phase) * np.sqrt(2 / 32), np.ones(len(z))]
    f = features(a)
    weights = np.linalg.solve(f.T @ f + quality_classifier.PENALTY * len(a) * np.eye(33) / 32, f.T @ n)
    nodes, values = learning.isotonic(features(x(False)) @ weights, y(False), np.ones(len(y(False))))
    want = {r.doc_id: np.clip(np.interp(features(np.array([quality_classifier.statistics((r.text or "").encode())])) @ weights, nodes, values), 0, 1)[0] for r in docs.limit(200).collect()}
    got = {r.doc_id: r["__quality"].score for r in quality_classifier.score(docs, model).collect()}
    assert np.mean([abs(got[i] - s) < 1e-6 for i, s in want.items()]) > 0.99  # steps of the calibration may turn on the last digit


def test_language_against_dense_algebra(spark):
    """Sets of n-grams, the Nyström features and the ridge solution, computed plainly."""
    words = {"aa": "la mano negra del norte sobre el agua clara", "bb": "the dark hand of winter on clear water"}
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(w.split(), k=12))) for k, w in words.items() for _ in range(30)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    model = language_id.fit(docs, texts=20, landmarks=4, n_grams=150)
    sample, names = language_id._sample(docs, "text", "lang", F.lit(True), 20)
    sample = sorted(sample.collect(), key=lambda r: (r.lang, r.h))

    def grams(t):
        b = (" " + t + " ").encode()
        return {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}

    landmarks = [grams(r.text) for k in names for r in [x for x in sample if x.lang == k][:4]]
    counts = Counter(g for s in landmarks for g in s)
    code = lambda g: len(g) << 32 | int.from_bytes(g, "little")
    chosen = set(sorted(counts, key=lambda g: (-counts[g], code(g)))[:150])
    landmarks = [s & chosen for s in landmarks]
    kernel = lambda s: np.array([len(s & m) / np.sqrt(max(len(s), 1) * max(len(m), 1)) for m in landmarks])
    values, vectors = np.linalg.eigh(np.array([kernel(m) for m in landmarks]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    f = np.array([np.r_[kernel(grams(r.text) & chosen) @ root, 1.0] for r in sample])
    y = np.array([[1.0 if r.lang == k else -1.0 for k in names] for r in sample])
    solved = np.linalg.solve(f.T @ f + language_id.PENALTY * len(f) * np.eye(f.shape[1]), f.T @ y)
    texts = ["la mano the water", "norte sobre", "dark dark hand", "zzz"]
    got_names, got_scores = model.predict(texts)
    for t, name, score in zip(texts, got_names, got_scores):
        value = np.r_[kernel(grams(t) & chosen) @ root, 1.0] @ solved
        soft = np.exp(language_id.SHARPNESS * (value - value.max()))
        assert name == names[int(value.argmax())] and abs(score - soft.max() / soft.sum()) < 1e-3


def test_no_ngram_is_lost():
    chosen = np.unique(np.random.default_rng(1).integers(0, 1 << 35, 8192, dtype=np.uint64))
    grams = language_id.Grams(chosen)
    assert np.array_equal(grams.table[grams.slot(chosen)], np.arange(1, len(chosen) + 1))


def test_toxicity_against_plain_compression(spark):
    """Each window compressed with both dictionaries, one after the other, without a memory."""
    import math

    import zstandard

    texts = [f"some plain words idiot here number{i} moron" + " x" * i for i in range(40)] + [f"some plain words here number{i}" + " y" * i for i in range(120)]
    model = toxicity.train(texts, [1] * 40 + [0] * 120, {0: 1.0, 1: 1.0})

    def size(content: bytes, x: bytes) -> int:
        kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(5, min_match=5, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        kept.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=kept, compression_params=how).compress(toxicity.window(x)))

    for t in ["", "plain words", "you idiot moron idiot", "idiot " + "calm " * 300, "w" * 500 + " idiot"]:
        words = t.encode().split()
        hits = [size(model.ordinary, w) - size(model.toxic, w) >= model.least_gain for w in words]
        n = min(len(words), toxicity.PASSAGE)
        rate = max([sum(hits[i : i + n]) for i in range(len(words) - n + 1)], default=0) / math.sqrt(n + toxicity.ADDED) if any(hits) else 0.0
        assert model.rate(t) == rate
        assert model.score(t) == float(np.clip(np.interp(rate, model.nodes, model.values), 0, 1))
    assert model.score("you idiot moron idiot") > model.score("plain words")


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(50)] + [(5, None), (None, "none")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)] + [(1, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = learning.labelled_sample(docs, labels, "quality", F.lit(True), 4)[0].collect()
    assert len(rows) == len({r.id for r in rows}) == 4 and all(r.y == (0 if r.id == 1 else r.id % 2) for r in rows)
    every = learning.labelled_sample(docs, labels, "quality", F.lit(True), {0: 9, 1: 9})[0].collect()
    assert sorted(r.id for r in every) == [0, 1, 2, 3, 4, 5] and {r.id: r.text for r in every}[5] == ""


def test_long_windows_are_not_remembered():
    model = toxicity.train(["some idiot"] * 3 + ["plain words"] * 5, [1] * 3 + [0] * 5, {})
    model.gains([b"a" * 65, b"short"])
    assert b"short" in model._ready[2] and b"a" * 65 not in model._ready[2]
    use = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    long = "q1w2e3" * 40
    assert use.count(long) == len(use.model.encode(long)) and token_counts.SPACE + long not in use.known


def test_all_telling_strings_count():
    words = [bytes([97 + i // 26, 97 + i % 26]) * 2 + b"q" for i in range(100)]
    got = toxicity.contrast([[b"plain", w] for w in words for _ in range(20)], [[b"plain"]] * 4000)
    assert {s.strip() for s in got} == set(words)


def test_toxic_passages_are_not_diluted():
    texts = ["some plain words here idiot" + " x" * i for i in range(20)] + ["some plain words here " + "y" * i for i in range(60)]
    model = toxicity.train(texts, [1] * 20 + [0] * 60, {})
    insult, plain = "idiot " * 200, "plain words " * 10_000
    assert model.rate(insult) > 0 and model.rate(plain) == 0
    assert model.rate(plain + insult + plain) == model.rate(insult) > model.rate("idiot " * 3 + plain)


def test_language(spark):
    got = registry.op5(spark, SF).where("held_out").join(table(spark, "documents"), "doc_id").collect()
    assert accuracy(got, lambda r: r.lang_pred == r.lang) > 0.97


def test_classifiers_on_awkward_rows(spark, nasty, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 40)] + [(None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    every = F.lit(True)
    for known in (labels, none):
        for module, out in ((quality_classifier, "__quality"), (toxicity, "__toxicity")):
            model = module.fit(nasty, known, every)
            got = module.score(nasty, model).collect()
            assert len(got) == nasty.count() and all(0 <= r[out].score <= 1 and r.score == "x" for r in got)
            assert module.score(nothing, module.fit(nothing, known, every)).count() == 0
    model = language_id.fit(nasty, learn=bucket_of("doc_id", 4) != 2)
    got = language_id.predict(nasty, model).collect()
    assert len(got) == nasty.count()
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r["__lang"].lang_pred, r["__lang"].score) == ("und", 0.0)
        else:
            assert r["__lang"].lang_pred in ("en", "fr") and 0 <= r["__lang"].score <= 1
    nobody = language_id.fit(nothing)
    assert {r["__lang"].lang_pred for r in language_id.predict(nasty, nobody).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


def test_copies_do_not_thin_out_a_language(spark):
    rows = [("aa", "copied text")] * 5000 + [("aa", f"other text {i}") for i in range(9)] + [("bb", f"noch ein text {i}") for i in range(20)]
    docs = spark.createDataFrame([("cc", "all copies")] * 5000 + rows, "lang string, text string")
    sample, languages = language_id._sample(docs, "text", "lang", F.lit(True), 10)
    assert Counter(r.lang for r in sample.collect()) == {"aa": 10, "bb": 10, "cc": 1} and languages == ["aa", "bb", "cc"]


def test_kernel_counts_shared_grams():
    grams = language_id.Grams(np.unique(language_id.codes(language_id.folded("abc abd"))))
    x = grams.presence(["abc abd", "abd", ""])
    own = lambda t: {bytes(language_id.folded(t)[i : i + n]) for n in range(1, 5) for i in range(len(language_id.folded(t)) - n + 1)}
    assert x[0].sum() == len(grams.chosen) - 1 and x[0] @ x[1] == len(own("abc abd") & own("abd"))


# neighbours


def brute_neighbours(rows, k):
    fine = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    size = Counter(len(v) for _, v in fine).most_common(1)[0][0] if fine else 0
    fine = [(i, np.array(v)) for i, v in fine if len(v) == size]
    return {q: sorted(((-float((x * v).sum()), i) for i, v in fine if i != q))[:k] for q, x in fine if q % 20 == 0}


def test_neighbours_recall(spark):
    e = table(spark, "embeddings")
    got = defaultdict(list)
    for r in registry.op3(spark, SF).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_neighbours([(r.vec_id, r.embedding) for r in e.collect()], 20)
    assert got.keys() == want.keys()
    hits = [len({v for _, v, _ in got[q]} & {i for _, i in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9 and all(sorted(r for r, _, _ in g) == list(range(1, 21)) for g in got.values())


def test_neighbours_of_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(80)]
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 2.0, 3.0]), (260, [float("nan")] * 4), (280, [float("inf"), 1.0, 1.0, 1.0]), (300, [1.0]), (None, [1.0] * 4), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1), "v": F.lit(2)}).repartition(3)
    want = brute_neighbours(rows, 20)
    got = defaultdict(list)
    for r in ann.search(df, F.pmod("id", F.lit(20)) == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q in want:
        assert len(got[q]) == 20
        if 100 <= q < 180:  # all nearest ones are copies: ties by id
            assert [v for _, v, _ in sorted(got[q])] == [i for _, i in want[q]]


def test_neighbours_by_cells(spark, monkeypatch):
    """Fifty thousand vectors in clusters, one of which holds a third: recall, share visited, no scan of all."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(400, 16))
    which = np.where(rng.random(50_000) < 1 / 3, 0, rng.integers(0, 400, 50_000))
    x = centres[which] + 0.15 * rng.normal(size=(50_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 3000)  # many buckets, the hot one salted
    fit, scan, seen = ann.fit, ann._exhaustive, []
    monkeypatch.setattr(ann, "fit", lambda *a: seen.append(fit(*a)) or seen[-1])
    monkeypatch.setattr(ann, "_exhaustive", lambda d, q, *a: seen.append(q.count()) or scan(d, q, *a))
    got = defaultdict(set)
    for r in ann.search(df, F.pmod("id", F.lit(100)) == 0).collect():
        got[r.query_id].add(r.vec_id)
    scores = x[::100] @ x.T
    scores[np.arange(500), np.arange(500) * 100] = -9
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    print("share", seen[0].share, "width", seen[0].width, "probes", seen[0].probes, "scanned", seen[1:])
    assert np.mean([len(got[i * 100] & set(b.tolist())) / 20 for i, b in enumerate(best)]) >= 0.9
    assert seen[0].reached and seen[0].share < 0.35 and sum(seen[1:]) <= 50


def test_extreme_vectors(spark):
    rows = [(20, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1e-200, 0.0]), (40, [0.0, 1e-200]), (3, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.pmod("id", F.lit(20)) == 0).collect()}
    assert got == {(q, i) for q in (20, 40) for i, _ in rows if i != q}


def test_recall_on_data_without_clusters(spark, monkeypatch):
    """Some setting always reaches the wanted recall: no query falls back to a scan."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).normal(size=(1000, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit, scan, seen = ann.fit, ann._exhaustive, []
    monkeypatch.setattr(ann, "fit", lambda *a: seen.append(fit(*a)) or seen[0])
    monkeypatch.setattr(ann, "_exhaustive", lambda *a: seen.append("scan") or scan(*a))
    got = defaultdict(set)
    for r in ann.search(df, F.pmod("id", F.lit(20)) == 0, k=5).collect():
        got[r.query_id].add(r.vec_id)
    want = brute_neighbours(rows, 5)
    assert len(seen) == 1 and seen[0].reached and seen[0].share < 1
    assert np.mean([len(got[q] & {i for _, i in near}) / 5 for q, near in want.items()]) >= 0.9


def test_fitted_figures_are_those_of_the_tables():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    index = ann.fitted(v, np.arange(300), 8, float(np.linalg.norm(v, axis=1).max()), 10)
    tables, visits = ann.Tables(index, v), index.visited(v[:5])
    full = ann.Index(index.dim, index.largest, index.directions, index.shifts, index.per_table, index.width, 3**index.per_table)
    for visit, first in zip(visits, ann.first_visits(full, v, v[:5])):
        assert np.flatnonzero(first < index.probes).tolist() == tables.candidates(visit).tolist()


def test_fitting_takes_no_more_than_its_sample(spark):
    rows = spark.range(60_000).select(F.col("id").alias("vid"), F.array(F.rand(1), F.rand(2)).alias("v"))
    for n in (60_000, 10**10):  # as many as there are, and as if there were many more
        assert ann.fit(rows, 2, 2.0, n, 5).reached == (n == 60_000)


def test_samples_hold_rows_at_any_size(spark):
    """Two thousand million rows give about as many as wanted; equal rows are drawn one by one."""
    many = 2_000_000_000
    assert 800 < drawn(spark.range(many), many, 1000).count() < 1200
    assert 800 < drawn(spark.range(300_000).select(F.lit("same")), 300_000, 1000).count() < 1200
    assert drawn(spark.range(50), 50, 1000).count() == 50 and drawn(spark.range(0), 0, 1000).count() == 0


def test_order_of_rules_comes_from_figures(spark):
    same = spark.createDataFrame([("$#%&|<>*$#% a b c d e f g h i j k",)] * 3000, "text string")
    measured = quality_rules.measure(same, "text", quality_rules.RULES)
    assert {r[0]: r[2] for r in measured}["too_many_symbols"] == 1.0 and all(r[1] > 0 for r in measured)
    assert quality_rules.plan(measured, quality_rules.RULES)[0] != sorted(quality_rules.RULES)[0]


def test_later_rules_do_not_see_rejected_rows(spark, tmp_path):
    """A rule that fails on what the first one rejects is never called on it."""

    def never(d):
        raise AssertionError("a rejected text was shown")

    text = "a b c d e f g h i j k l m n"
    order = [("first", 1.0, 1.0), ("never", 1.0, 0.0)]
    docs = spark.createDataFrame([(text + str(i),) for i in range(20)], "text string")
    quality_rules_measure = quality_rules.measure
    quality_rules.measure = lambda *a, **k: order
    try:
        got = quality_rules.judge(docs, rules={"never": never, "first": lambda d: True}).collect()
    finally:
        quality_rules.measure = quality_rules_measure
    assert {r["__rules"]["rejected_by"] for r in got} == {"first"}



def test_few_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search(df, F.pmod("id", F.lit(20)) == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 1, 0.5), (20, 2, 2, -1.0)]
    assert ann.search(df.limit(0), F.pmod("id", F.lit(20)) == 0).count() == 0
    one = df.where("vec_id = 20")
    assert ann.search(one, F.pmod("id", F.lit(20)) == 0).count() == 0


# mixing


def brute_shares(children, given):
    """children: name -> (room, weight): water-filling by rounds."""
    out = dict.fromkeys(children, 0.0)
    left, open_ = given, {k for k, (room, w) in children.items() if w > 0 and room > 0}
    while open_ and left > 1e-9:
        w = sum(children[k][1] for k in open_)
        step = min([left / w] + [(children[k][0] - out[k]) / children[k][1] for k in open_])
        for k in open_:
            out[k] += step * children[k][1]
        left -= step * w
        open_ = {k for k in open_ if children[k][0] - out[k] > 1e-9}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{a}", f"l{b}", f"s{c}"): rng.choice([0, 5, 50, 500]) for a in range(3) for b in range(3) for c in range(3)}
    weights = [
        {"domain": {"d0": 3.0, "d1": 1.0, "d2": 0.0}, "lang": {"l0": 2.0}, "source": {"s1": 5.0}},
        {"domain": {"d0": 3.0}, "lang": {"l0": 0.0, "l1": 4.0}, "source": {"s1": 5.0}},
        {"domain": {"d1": 2.0}, "lang": {"l2": 2.0}, "source": {"s0": 0.0, "s2": 0.0}},
        {"domain": {"d0": 0.0}, "lang": {"l1": 0.0}, "source": {"s2": 0.0, "s1": 3.0}},
    ][seed]
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in mixing.budgets(df, 0.9, 2, weights).collect()}
    w = lambda level, name: weights[level].get(name, 1.0)
    some = {k: v for k, v in leaves.items() if all(w(level, name) > 0 for level, name in zip(mixing.LEVELS, k))}
    room = lambda p: 2 * sum(v for k, v in some.items() if k[: len(p)] == p)
    domains = brute_shares({d: (room((d,)), w("domain", d)) for d in ("d0", "d1", "d2")}, min(int(0.9 * sum(leaves.values())), room(())))
    for d, x in domains.items():
        langs = brute_shares({b: (room((d, b)), w("lang", b)) for b in ("l0", "l1", "l2")}, x)
        for b, y in langs.items():
            for s, z in brute_shares({c: (room((d, b, c)), w("source", c)) for c in ("s0", "s1", "s2")}, y).items():
                assert abs(got.get((d, b, s), 0) - int(z + 1e-6)) <= 1
    wanted = min(int(0.9 * sum(leaves.values())), room(()))
    assert wanted - len(leaves) <= sum(got.values()) <= wanted


def test_shortage_of_a_zero_weight_goes_on(spark):
    """What a language without weight cannot take goes to its siblings, then to the other domain."""
    df = spark.createDataFrame([("a", "x", "s", 100), ("a", "y", "s", 100), ("b", "x", "s", 800)], "domain string, lang string, source string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in mixing.budgets(df, 0.6, 1, {"lang": {"y": 0.0}}).collect()}
    assert got == {("a", "x", "s"): 100, ("b", "x", "s"): 500}


def test_mixing_awkward_rows(nasty, nothing):
    out = mixing.mix(nasty, registry.domain(), registry.MIX_WEIGHTS, share=0.5, max_epochs=2, seed=3)
    assert out.columns == [*nasty.columns, "__mix"]
    rows = out.collect()
    taken = sum(r["__mix"].take_tokens for r in rows)
    total = sum(len((r.text or "").split()) for r in nasty.collect())
    assert 0 < taken <= total * 0.5 + 1 and all(r["__mix"].take_tokens <= r["__mix"].n_tokens for r in rows)
    assert mixing.mix(nothing, registry.domain(), registry.MIX_WEIGHTS).count() == 0
    every = mixing.mix(nasty, registry.domain(), {}, share=10.0, max_epochs=2).collect()
    assert sum(r["__mix"].take_tokens for r in every) == 2 * total
