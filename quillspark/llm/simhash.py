"""SimHash near-duplicates, linked by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits agree up
to one bit in a segment, so the Hamming ball of radius one around each segment value, looked up in the table
of that segment's values, finds every link; complete distances are then verified. Work follows distinct
segment values, not documents: equal fingerprints are folded first (map-side), a ball is enumerated once per
value, and inside a table match a breadth-first search takes each fingerprint out of the unvisited set when
it is first reached, so dense groups cost nearly linear time and emit a star instead of all pairs. Matches
with more than HOT fingerprints are dealt on by an equal byte of the other segment (also guaranteed by the
pigeonhole principle), and what is still hot by an equal quarter of its other 24 bits; then 18 bits are free, so no
group exceeds 2**19 fingerprints, whatever the input. Components come from contraction rounds over the remaining
edges, each to the neighbour of least random priority, so that their number grows with the logarithm of a chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, release, saved, text_bytes, trimmed

SHINGLE = 3
SEED = 42
MAX_BITS = 3
HOT = 20000
#: Keys of removed rows that may be broadcast (about 60 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit majority of the XXH64 hashes of the word shingles of UTF-8 text; no word: zero."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    last = (ends - 1).tolist()[size - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = pa.array(np.array([fingerprint(b) for b in text_bytes(texts)], np.uint64).view(np.int64))
    release()
    return found


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    return docs.withColumn(out, _fingerprints(F.col(text_col)))


def stars(values: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph on distinct values with links at ``max_bits`` or fewer differing bits."""
    left = np.sort(values)
    a, b = [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= max_bits
            if near.any():
                reached, left = left[near], left[~near]
                queue.extend(reached)
                a.append(np.full(len(reached), root, np.uint64))
                b.append(reached)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _search(max_bits: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (match, fp) in order of match -> edges."""
        held_key, held = None, []

        def edges(parts):
            values = np.unique(np.concatenate(parts))
            if len(values) > 1:
                a, b = stars(values, max_bits)
                if len(a):
                    return [(a, b)]
            return []

        for table in batches:
            keys, values = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            out = []
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
                if keys[i] != held_key:
                    if held:
                        out += edges(held)
                    held_key, held = keys[i], []
                held.append(values[i:j])
            if out:
                yield _edge_batch(out)
        if held and (out := edges(held)):
            yield _edge_batch(out)

    return search


def _edge_batch(out):
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (column fp) that span every component of the link graph."""
    if max_bits > 3:
        raise ValueError("two segments and balls of radius one find links of at most 3 bits")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    table = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("k"), low.alias("a")), F.struct(F.lit(1).alias("k"), high.alias("a")))).alias("s")).select("fp", "s.k", "s.a")
    values = table.groupBy("k", "a").agg(F.count("*").alias("n"))
    values = saved(values)
    ball = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("a").bitwiseXOR(F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2), i).cast("long")))
    # each unordered pair of neighbouring values once, from the smaller one
    probes = values.select("k", "a", "n", F.explode(F.filter(ball, lambda x: x > F.col("a"))).alias("b"))
    near = probes.join(values.select("k", F.col("a").alias("b"), F.col("n").alias("m")), ["k", "b"])
    pairs = near.select("k", "a", "b", (F.col("n") + F.col("m")).alias("n")).unionByName(values.where("n > 1").select("k", "a", F.col("a").alias("b"), "n"))
    match = pairs.withColumn("match", F.xxhash64("k", "a", "b"))
    sides = match.select("k", "match", "n", F.explode(F.array_distinct(F.array("a", "b"))).alias("a"))
    members = sides.join(table, ["k", "a"])
    members = members.withColumn("rest", F.when(F.col("k") == 0, high).otherwise(low))
    dealt = members.where(F.col("n") <= hot).select("match", "fp")
    if not pairs.where(F.col("n") > hot).isEmpty():
        once = saved(_dealt(members.where(F.col("n") > hot), 32))
        still = once.groupBy("match").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("match")
        twice = _dealt(once.join(still, "match", "left_semi"), 24)
        dealt = dealt.unionByName(once.join(still, "match", "left_anti").select("match", "fp")).unionByName(twice.select("match", "fp"))
    return dealt.repartition("match").sortWithinPartitions("match").mapInArrow(trimmed(_search(max_bits)), "u long, v long")


def _dealt(members: DataFrame, width: int) -> DataFrame:
    """Each member (match, fp, rest) once for each quarter of its ``width`` free bits: rests that differ in three
    bits at most agree in a quarter. ``rest`` holds the other three quarters afterwards."""
    part = width // 4
    cuts = [
        F.struct(
            F.lit(j).alias("j"),
            F.shiftrightunsigned("rest", part * j).bitwiseAND(F.lit((1 << part) - 1)).alias("x"),
            F.shiftleft(F.shiftrightunsigned("rest", part * (j + 1)), part * j).bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << part * j) - 1))).alias("rest"),
        )
        for j in range(4)
    ]
    return members.select("match", "fp", F.explode(F.array(*cuts)).alias("d")).select(F.xxhash64("match", "d.j", "d.x").alias("match"), "fp", "d.rest")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (u, v) touches, by rounds of contraction.

    In a round each node joins the least of its neighbours and itself, by a hash that changes with the round. By ids, a
    chain in their order would lose one link a round; by random priorities about half the nodes go each time.
    """
    edges = saved(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("p"), F.col(c).alias("m"))
        step = both.groupBy("u").agg(F.min(order("v")).alias("v"))
        step = saved(step.select(F.col("u").alias("node"), F.least(F.col("v"), order("u"))["m"].alias("m")))
        maps.append(step)
        a = step.select(F.col("node").alias("u"), F.col("m").alias("mu"))
        b = step.select(F.col("node").alias("v"), F.col("m").alias("mv"))
        edges = saved(edges.join(a, "u").join(b, "v").where("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct())
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[-1].select("node", F.col("m").alias("root"))
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("m"), F.col("root").alias("later"))
        out = step.join(later, "m", "left").select("node", F.coalesce("later", "m").alias("root"))
        out = saved(out)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id that links reach).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows are
    returned as often as given. A null id is never a component_id, unless all ids of a component are null.
    Other columns are ignored; empty table: no rows.
    """
    prepare(docs.sparkSession)
    marked = saved(with_fingerprint(docs.select(F.col(id_col), F.col(text_col)), text_col, "fp").select(F.col(id_col), "fp"))
    of = saved(least_of(marked, F.min(id_col), max_bits))
    return marked.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def least_of(marked: DataFrame, least: Column, max_bits: int) -> DataFrame:
    """(fp, least): for each fingerprint of ``marked`` the least value in its component; ``least`` is a minimum."""
    fps = saved(marked.groupBy("fp").agg(least.alias("least")))
    roots = components(links(fps.select("fp"), max_bits))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("least")), "root").select("fp", "least")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one of the least id, of equal ids the one whose text has the least
    MD5; null ids come last, null texts count as empty.

    Rows, not ids, are removed: different texts under one id, or without an id, stay if their components differ.
    Rows that are equal in id and text are one document; one of them stays. Empty table: no rows. Texts are not
    shuffled as long as the keys of the rows to remove may be broadcast, and no row repeats.
    """
    prepare(docs.sparkSession)
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    narrow = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp")
    marked = saved(narrow.select("id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "fp"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    of = least_of(marked, F.min(key), MAX_BITS)
    best = (F.col("id").eqNullSafe(F.col("least.id"))) & (F.col("digest") == F.col("least.digest"))
    keys = marked.join(of, "fp").groupBy("id", "digest").agg(F.max(best).alias("kept"), F.count("*").alias("n"))
    keys = saved(keys)
    gone = keys.where(~F.col("kept")).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    rest = docs.withColumn("__text", digest)
    rest = rest.join(gone, rest[id_col].eqNullSafe(gone["__id"]) & (rest["__text"] == gone["__digest"]), "left_anti")
    if not keys.where("kept and n > 1").isEmpty():
        rest = rest.dropDuplicates([id_col, "__text"])
    return rest.drop("__text")
