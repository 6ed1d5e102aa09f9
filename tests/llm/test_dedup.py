"""Suffix-array and SimHash deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillspark.llm import simhash, suffix_dedup


def brute_spans(docs, n):
    """docs: (key, bytes) in order -> removed flags of each."""
    seen, out = set(), []
    for _, b in docs:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w in seen:
                gone[s : s + n] = True
            seen.add(w)
        out.append(gone)
    return out


def facts(b, gone):
    rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
    return len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest()


@pytest.mark.parametrize("seed", range(20))
def test_transform_search(seed):
    rng = random.Random(seed)
    blocks = [bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 60))) for _ in range(8)]
    blocks.append(blocks[0][3:] + b"zz")
    strings, place = np.array([max(0, len(b) - 4) for b in blocks]), np.arange(len(blocks)) << 40
    got = {(int(b), int(o)) for b, o in zip(*suffix_dedup.repeated_starts(blocks, strings, place, 5))}
    seen, want = set(), set()
    for i, x in enumerate(blocks):
        for s in range(len(x) - 4):
            if x[s : s + 5] in seen:
                want.add((i, s))
            seen.add(x[s : s + 5])
    assert got == want


def test_blocks_own_every_string():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(3000)), np.uint8)
    own, start, count, _, _ = suffix_dedup.blocks_of(data, np.array([1000, 50, 1950]))
    starts = sorted((int(o), int(s) + k) for o, s, n in zip(own, start, count) for k in range(n))
    assert starts == [(0, i) for i in range(901)] + [(2, i) for i in range(1851)]


def check(rows, got, n):
    docs = [(i, (t or "").encode()) for i, t in sorted(rows)]
    want = {i: facts(b, g) for (i, b), g in zip(docs, brute_spans(docs, n))}
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def result(df, **kw):
    return suffix_dedup.dedup(df, **kw).select("doc_id", "__dedup.n_bytes", "__dedup.n_removed", "__dedup.n_spans", "__dedup.kept_sha256")


def test_awkward_documents(clean):
    rows = [(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()]
    check(rows, result(clean).collect(), 100)


@pytest.mark.parametrize("hot, slots, singles", [(1, 19, 1 << 16), (1, 1, 3), (4000, 19, 1), (4000, 2, 1)])
def test_shared_passage_in_different_places(spark, hot, slots, singles):
    """A passage in many documents, each time between other words: also where its anchors are dealt on, and
    where tasks soon forget what they sent."""
    limits = suffix_dedup.Limits(piece=1 << 10, transform_bytes=1 << 12, hot_blocks=hot, slot_bits=slots, single_strings=singles)
    rng = random.Random(1)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = noise(300)
    rows = [(i, noise(rng.randrange(200)) + passage + noise(rng.randrange(200))) for i in range(40)] + [(99, passage[5:150] + passage[100:])]
    check(rows, result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), limits=limits).collect(), 100)


def test_rows_of_a_common_anchor_are_spread():
    """A task sends at most two rows of an anchor to be counted, over any number of batches."""
    rng = random.Random(6)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = noise(200)
    tables = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([noise(80) + passage + noise(80)])], names=["id", "text"]) for i in range(30)]
    rows = [r for t in suffix_dedup.find_blocks(iter(tables), 100, 32) for r in zip(*(t.column(i).to_pylist() for i in (0, 3)))]
    counted, spread = Counter(a for a, start in rows if start >= 0), Counter(a for a, start in rows if start < 0)
    assert max(counted.values()) == 2 and max(spread.values()) == 28
    assert all(counted[a] == 2 for a in spread)


def test_single_strings_are_sent_once():
    """Of a string dealt singly a task sends places earlier than those sent; the others leave as runs."""
    text = "0123456789" * 10 + "ab"
    want = [{"anchor": 7, "id": i, "start": 0, "strings": 3, "hot": True} for i in (5, 9, 2)]
    tables = [pa.RecordBatch.from_arrays([pa.array([text]), pa.array([[w]])], names=["text", "wanted"]) for w in want]
    rows = [r for t in suffix_dedup._cut_blocks(iter(tables), 100) for r in zip(*(t.column(i).to_pylist() for i in (1, 2, 3)))]
    assert rows == [(5, 0, 1), (5, 1, 1), (5, 2, 1), (9, 0, -102), (2, 0, 1), (2, 1, 1), (2, 2, 1)]


def test_text_beyond_one_piece(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcd") for _ in range(5000))
    rows = [(1, long), (2, "x" + long[1000:4000] + "y"), (3, long[:500] * 3)]
    check(rows, result(spark.createDataFrame(rows, "doc_id long, text string"), limits=suffix_dedup.Limits(piece=1 << 10)).collect(), 100)


def test_repeated_and_null_ids(nasty):
    """Rows equal in id and text are one document; null ids come last."""
    got = suffix_dedup.dedup(nasty, with_text=True).select("doc_id", "text", "__dedup.*").collect()
    keys = sorted({(r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest(), r.text) for r in got}, key=lambda k: k[:3])
    docs = [(k, (k[3] or "").encode()) for k in keys]
    want = {(k[0], k[1], k[3]): facts(b, g) for (k, b), g in zip(docs, brute_spans(docs, 100))}
    assert len(got) == nasty.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[(r.doc_id is None, r.doc_id or 0, r.text)]


def test_no_documents(nothing):
    assert result(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(values):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("table", ["nasty", "clean"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    got = simhash.near_duplicates(df).collect()
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    prints = {(i, t): brute_fingerprint(t) for i, ts in texts.items() for t in ts}
    roots = brute_components(prints.values())
    least: dict = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted(repr((i, f"{brute_fingerprint(t):016x}", least.get(roots[brute_fingerprint(t)]))) for i, ts in texts.items() for t in ts)
    assert sorted(repr(tuple(r)) for r in got) == want


@pytest.mark.parametrize("hot", [2, 20000])
def test_links_of_planted_fingerprints(spark, hot):
    """Chains, dense groups and values that agree in one half only."""
    rng = random.Random(8)
    values = set()
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(60):
            values.add(v)
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
    base = rng.getrandbits(32)
    values |= {base << 32 | rng.getrandbits(32) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), hot=hot)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(values)
    group = defaultdict(set)
    for v, s in zip(values, signed):
        group[roots.get(s, s)].add(want[v])
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(want.values()))


def brute_kept(rows):
    """(id, text) of the first row of each component by id (null last) and digest of the text."""
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    first: dict = {}
    for (i, t), f in zip(rows, prints):
        key = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest())
        first[roots[f]] = min(first.get(roots[f], (key, i, t)), (key, i, t), key=lambda x: x[0])
    return sorted(repr((i, t)) for _, i, t in first.values())


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_keep_one(nasty, broadcast, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
    kept = simhash.keep_one(nasty)
    assert kept.columns == nasty.columns
    rows = [(r.doc_id, r.text or "") for r in nasty.select("doc_id", "text").collect()]
    assert sorted(repr((r.doc_id, r.text or "")) for r in kept.collect()) == brute_kept(rows)


def test_keep_one_with_repeated_and_null_ids(spark):
    """Different texts under one id, or without an id, all stay; copies go."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(30)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[0]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (2, texts[4]), (3, texts[4]), (None, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (None, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_chains_take_few_rounds(spark, order, monkeypatch):
    nodes = [i * 7919 % 100_003 for i in range(2000)]
    nodes = sorted(nodes) if order == "up" else sorted(nodes, reverse=True) if order == "down" else nodes
    tables, save = [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df: tables.append(1) or save(df))
    roots = simhash.components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "u long, v long")).collect()
    assert len({r.root for r in roots}) == 1 and {r.node for r in roots} == set(nodes)
    assert len(tables) <= 3 * 16  # two or three a round


def test_hot_matches_are_dealt_twice(spark):
    """Fingerprints that agree in one half and in a quarter of the other."""
    rng = random.Random(9)
    base = rng.getrandbits(32) << 32
    values = {base | 0xAB << 24 | rng.getrandbits(24) for _ in range(400)}
    values |= {v ^ sum(1 << b for b in rng.sample(range(64), 3)) for v in list(values)[:50]}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), hot=20)).collect()}
    want, group = brute_components(values), defaultdict(set)
    for v, s in signed.items():
        group[roots.get(s, s)].add(want[v])
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(want.values()))


def test_blocks_of_structured_strings():
    """Thue-Morse strings and their complements, which defeat polynomials modulo powers of two, are told apart."""
    t = [bin(i).count("1") % 2 for i in range(128)]
    a, b = bytes(97 + x for x in t), bytes(98 - x for x in t)
    _, _, _, _, whole = suffix_dedup.blocks_of(np.frombuffer(a + b, np.uint8), np.array([128, 128]), 100, 32)
    one, _, _, _, first = suffix_dedup.blocks_of(np.frombuffer(a, np.uint8), np.array([128]), 100, 32)
    _, _, _, _, second = suffix_dedup.blocks_of(np.frombuffer(b, np.uint8), np.array([128]), 100, 32)
    assert not set(first.tolist()) & set(second.tolist()) and set(whole.tolist()) == set(first.tolist()) | set(second.tolist())
