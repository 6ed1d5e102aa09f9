"""Removal of long byte strings that occur earlier in the corpus.

Method: threshold-bounded interval expansion. A Burrows-Wheeler transform of the candidate text is
searched breadth first by backward extension; each extension of an interval whose right border is new
fixes one common-prefix value, by increasing value, and the search stops at the minimum length. Borders
still open then separate suffixes that share at least the minimum length.

Scaling. Every string of MIN_LEN bytes is owned by one anchor, the smallest of its hashed SEED_LEN-byte
seeds, so equal strings always meet at equal anchors (minimum-substring partitioning). Consecutive
strings with one anchor form a *block*. Blocks that occur once under their anchor hash are dropped after
one shuffle of fixed-width rows; equal blocks are folded to their earliest place (first within each Arrow
batch, before any shuffle); the rest are dealt by anchor into transforms of bounded size. An anchor with
more than Limits.hot_blocks different blocks is dealt on by the single strings, so that no group grows with it.
Common passages do not gather either: a task sends two rows of an anchor to be counted and spreads the
others, and of a string that is dealt singly only places earlier than those it has sent already.

What a task folds depends on the order of its rows. docs should therefore be read from a table: rows that
come out of a shuffle can change their order when a lost task is run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, release, saved, text_bytes, trimmed, unique_key

MIN_LEN = 100
SEED_LEN = 32
POS_BITS = 24


class Limits(NamedTuple):
    """Sizes that bound memory; results do not depend on them."""

    #: Bytes hashed at once; positions within fit the low POS_BITS of a sort key.
    piece: int = 1 << 19
    #: Bytes of text of one transform.
    transform_bytes: int = 1 << 19
    #: Different blocks of an anchor above which its strings are dealt singly.
    hot_blocks: int = 4000
    #: Anchors (9 bytes each) and single strings that a task remembers; what it forgets is only sent once more.
    slot_bits: int = 19
    single_strings: int = 1 << 16


U = np.uint64
MULT = U(0x9E3779B97F4A7C15)
MULT_INV = U(pow(int(MULT), -1, 1 << 64))
#: Blocks count as equal if their anchors and their XXH3 values under this key are: seeds may be hashed by a
#: polynomial, which strings can be made to defeat, since equal seeds only bring blocks together.
BLOCK_SEED = 0x5DEECE66D1CE4E5B


def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


CODES = _byte_codes()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max([Limits().piece + 1, n, *_powers])  # a larger table serves as well
    if size not in _powers:
        up, down = np.full(size + 1, MULT, np.uint64), np.full(size + 1, MULT_INV, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(29))
    x *= U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def blocks_of(data: np.ndarray, lens: np.ndarray, min_len: int = MIN_LEN, seed_len: int = SEED_LEN):
    """Blocks of texts that are laid end to end: text index, start in the text, strings, anchor and block hash."""
    n, width = len(data), min_len - seed_len + 1
    offs = np.concatenate([[0], np.cumsum(lens)])
    empty = np.zeros(0, np.int64)
    if n < min_len:
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[data] * down[:n], out=sums[1:])
    seeds = _mix((sums[seed_len:] - sums[:-seed_len]) * up[: n - seed_len + 1])
    low = U((1 << POS_BITS) - 1)
    least = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(lens)), lens)[: len(anchor)]
    at = np.arange(len(anchor))
    inside = at + min_len <= offs[owner + 1]
    at, anchor, owner = at[inside], anchor[inside], owner[inside]
    if not len(at):
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[first, len(at)])
    begin = at[first]
    end = begin + count + min_len - 1
    bytes_ = memoryview(np.ascontiguousarray(data))
    whole = np.fromiter((xxhash.xxh3_64_intdigest(bytes_[i:j], BLOCK_SEED) for i, j in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
    return owner[first], begin - offs[owner[first]], count, seeds[anchor[first]], whole


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of text by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << U(8)) | padded[i : i + n]
    have = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.r_[False, ordered[1:] != ordered[:-1]]
        if have >= depth:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64) + U(1)
        if int(rank.max()) == n:
            return order
        key = rank << U(32)
        key[: n - have] |= rank[have:]
        have *= 2


def open_borders(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each row of the transform: True if it shares ``depth`` symbols with the row before.

    text ends with a symbol that is smaller than all others and occurs once. Rows need to be in order
    by their first ``depth`` symbols only.
    """
    n = len(text)
    last = text[order - 1]  # the transform: symbol before each suffix
    steps = np.empty(n, np.int64)
    steps[np.argsort(last, kind="stable")] = np.arange(n)  # row of the suffix that is one symbol longer
    head = text[order]
    fixed = np.zeros(n + 1, bool)  # borders whose common-prefix value is known
    fixed[0] = fixed[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(depth):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        source = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(total) + np.repeat(lo - np.cumsum(size) + size, size)
        packed = (steps[rows] << 32) | source
        packed.sort()
        row, source = packed >> 32, packed & 0xFFFFFFFF
        cut = np.r_[True, (row[1:] != row[:-1] + 1) | (source[1:] != source[:-1]) | (head[row[1:]] != head[row[:-1]])]
        begin = np.flatnonzero(cut)
        lows, highs = row[begin], row[np.r_[begin[1:] - 1, len(row) - 1]] + 1
        fresh = ~fixed[highs]
        lo, hi = lows[fresh], highs[fresh]
        fixed[hi] = True
    return ~fixed[:n]


def repeated_starts(blocks: list[bytes], strings: np.ndarray, place: np.ndarray, min_len: int = MIN_LEN):
    """Which strings of the blocks occur at an earlier place: arrays (block, offset).

    strings: number of string starts of each block; place: rank of each block's first byte in the corpus
    order, such that the places of a block's strings are place + offset.
    """
    lens = np.array([len(b) for b in blocks], np.int64)
    joined = np.frombuffer(b"\x00".join(blocks) + b"\x00", np.uint8).astype(np.uint16)
    ends = np.cumsum(lens + 1) - 1
    begins = ends - lens
    text = joined + np.uint16(2)
    text[ends] = 1
    # byte values are packed to a small range, so that eight symbols fit a sort key
    used = np.zeros(258, bool)
    used[text] = True
    codes = np.cumsum(used).astype(np.uint16)
    text = np.r_[codes[text], np.uint16(0)]
    if text.max() > 255:
        raise ValueError("more than 254 different bytes")
    text = text.astype(np.uint8)
    order = transform(text, min_len)
    same = open_borders(text, order, min_len)
    block = np.repeat(np.arange(len(blocks)), lens + 1)
    block = np.r_[block, len(blocks) - 1][order]
    offset = order - begins[block]
    counted = (offset >= 0) & (offset < strings[block])
    group = np.cumsum(~same)[counted]
    block, offset = block[counted], offset[counted]
    where = place[block] + offset
    by = np.lexsort((where, group))
    group, block, offset = group[by], block[by], offset[by]
    later = np.r_[False, group[1:] == group[:-1]] if len(group) else np.zeros(0, bool)
    return block[later], offset[later]


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs (touching intervals join)."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[first], ends[np.r_[first[1:] - 1, len(ends) - 1]]


BLOCK_SCHEMA = "anchor long, whole long, id long, start long, strings int"


def _pieces(table: pa.RecordBatch, limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, size = [], [], 0
    for i, b in zip(table.column(0).to_pylist(), text_bytes(table.column(1))):
        if size and size + len(b) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(b)
        size += len(b)
    if ids:
        yield ids, texts


def _long_text(i: int, b: bytes, min_len: int, seed_len: int, limit: int):
    """Blocks of one text beyond the limit, by overlapping parts; every string starts in one part only."""
    step = limit - min_len + 1
    for at in range(0, max(1, len(b) - min_len + 1), step):
        part = np.frombuffer(b, np.uint8)[at : at + limit]
        own, start, count, anchor, whole = blocks_of(part, np.array([len(part)]), min_len, seed_len)
        yield np.full(len(own), i, np.int64), start + at, count, anchor, whole


class SentAnchors:
    """How many rows of an anchor a task has sent to be counted, up to two. Slots are fixed in number; the
    latest anchor holds a slot."""

    def __init__(self, bits: int):
        self.shift = U(64 - bits)
        self.anchor = np.zeros(1 << bits, U)
        self.times = np.zeros(1 << bits, np.int8)

    def spare(self, anchor: np.ndarray) -> np.ndarray:
        """For rows in order of their anchor: True where two rows of it are sent before."""
        if not len(anchor):
            return np.zeros(0, bool)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[first, len(anchor)])
        unique = anchor[first]
        slot = ((unique * MULT) >> self.shift).astype(np.int64)
        before = np.where(self.anchor[slot] == unique, self.times[slot], 0)
        slot, at = np.unique(slot, return_index=True)
        self.anchor[slot] = unique[at]
        self.times[slot] = np.minimum(before + size, 2)[at]
        return np.arange(len(anchor)) - np.repeat(first - before, size) >= 2


def find_blocks(batches: Iterator[pa.RecordBatch], min_len: int, seed_len: int, limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """Blocks of each text. A block that occurs earlier in the batch is not sent on: its strings are
    repeats already, and they leave as a row without hashes (strings: minus the bytes of the run). A block
    whose anchor is known to be shared, by two rows of this task, has minus one minus its start as start."""
    sent = SentAnchors(limits.slot_bits)
    for table in batches:
        for ids, texts in _pieces(table, limits.piece):
            if len(texts) == 1 and len(texts[0]) > limits.piece:
                parts = list(_long_text(ids[0], texts[0], min_len, seed_len, limits.piece))
                doc, start, count, anchor, whole = (np.concatenate(x) for x in zip(*parts))
            else:
                data = np.frombuffer(b"".join(texts), np.uint8)
                own, start, count, anchor, whole = blocks_of(data, np.array([len(b) for b in texts], np.int64), min_len, seed_len)
                doc = np.array(ids, np.int64)[own]
            if not len(doc):
                continue
            by = np.lexsort((start, doc, whole, anchor))
            doc, start, count, anchor, whole = doc[by], start[by], count[by], anchor[by], whole[by]
            again = np.r_[False, (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])]
            # one row for each run of repeated blocks of a document
            rep = np.flatnonzero(again)
            rep = rep[np.lexsort((start[rep], doc[rep]))]
            rid, rs, re = _runs(doc[rep], start[rep], start[rep] + count[rep] + min_len - 1)
            keep = np.flatnonzero(~again)
            spare = sent.spare(anchor[keep])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[anchor[keep].view(np.int64), np.zeros(len(rid), np.int64)]),
                    pa.array(np.r_[whole[keep].view(np.int64), np.zeros(len(rid), np.int64)]),
                    pa.array(np.r_[doc[keep], rid]),
                    pa.array(np.r_[np.where(spare, -1 - start[keep], start[keep]), rs]),
                    pa.array(np.r_[count[keep], rs - re].astype(np.int32)),
                ],
                names=["anchor", "whole", "id", "start", "strings"],
            )


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Maximal runs of the intervals of each document, by document."""
    if not len(doc):
        return doc, start, end
    shift = int(end.max()) + 1
    codes, inverse = np.unique(doc, return_inverse=True)
    lo, hi = merge(start + inverse * shift, end + inverse * shift)
    own = lo // shift
    return codes[own], lo - own * shift, hi - own * shift


SPANS = "id long, start long, end long"


def search_blocks(batches: Iterator[pa.RecordBatch], min_len: int, limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """Transforms of bounded size over rows that come in order of their anchor.

    Rows: anchor, id, start, strings, block. An anchor's blocks always share a transform. Rows with minus
    the bytes of a run as strings are results already.
    """
    for rows, done in _by_anchor(batches, limits.transform_bytes):
        if done:
            rid, rs, size = (np.array(x, np.int64) for x in zip(*(r[1:4] for r in done)))
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(rs), pa.array(rs - size)], names=["id", "start", "end"])
        if not rows:
            continue
        # places: earlier documents and earlier starts are smaller; blocks of one document stay comparable
        ids, inverse = np.unique(rows["id"], return_inverse=True)
        place = (inverse.astype(np.int64) << 40) + rows["start"]
        block, offset = repeated_starts(rows["block"], rows["strings"], place, min_len)
        doc, at = rows["id"][block], rows["start"][block] + offset
        by = np.lexsort((at, doc))
        rid, rs, re = _runs(doc[by], at[by], at[by] + min_len)
        if len(rid):
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(rs), pa.array(re)], names=["id", "start", "end"])


def _by_anchor(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[dict, list]]:
    """Pairs of the rows of one transform and rows that need none (either may be empty)."""
    held: list[tuple] = []
    size, last = 0, None

    def pack(rows):
        return {
            "id": np.array([r[1] for r in rows], np.int64),
            "start": np.array([r[2] for r in rows], np.int64),
            "strings": np.array([r[3] for r in rows], np.int64),
            "block": [r[4] for r in rows],
        }

    for table in batches:
        done = []
        for row in zip(*(table.column(i).to_pylist() for i in range(5))):
            if row[3] < 0:
                done.append(row)
                continue
            if row[0] != last and size >= limit:
                yield pack(held), []
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[4])
        if done:
            yield {}, done
    if held:
        yield pack(held), []


def _cut_blocks(batches: Iterator[pa.RecordBatch], min_len: int, limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted blocks of each document; blocks of hot anchors are dealt by single strings, and
    those that the task has sent from an earlier place leave as runs (strings: minus the bytes of the run).

    Rows: text, wanted array<struct<anchor, id, start, strings, hot>>.
    """
    sent: dict[bytes, tuple[int, int]] = {}
    for table in batches:
        out: list[tuple] = []
        size = 0
        for b, wanted in zip(text_bytes(table.column(0)), table.column(1).to_pylist()):
            for w in wanted or ():
                piece = b[w["start"] : w["start"] + w["strings"] + min_len - 1]
                if w["hot"]:
                    gone = []
                    for k in range(w["strings"]):
                        one = piece[k : k + min_len]
                        if sent.get(one, (w["id"], w["start"] + k)) < (w["id"], w["start"] + k):
                            gone.append(w["start"] + k)
                            continue
                        if len(sent) >= limits.single_strings:
                            sent.clear()
                        sent[one] = (w["id"], w["start"] + k)
                        key = xxhash.xxh64_intdigest(one, w["anchor"] & 0xFFFFFFFF) - (1 << 63)
                        out.append((key, w["id"], w["start"] + k, 1, one))
                    lows = np.array(gone, np.int64)
                    for lo, hi in zip(*(x.tolist() for x in merge(lows, lows + min_len))):
                        out.append((xxhash.xxh64_intdigest(b"%d %d" % (w["id"], lo)) - (1 << 63), w["id"], lo, lo - hi, b""))
                else:
                    out.append((w["anchor"], w["id"], w["start"], w["strings"], piece))
                size += len(piece) * (w["strings"] if w["hot"] else 1)
                if size > 1 << 23:
                    yield _cut_batch(out)
                    out, size = [], 0
        if out:
            yield _cut_batch(out)


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())],
        names=["anchor", "id", "start", "strings", "block"],
    )


def repeated_spans(docs: DataFrame, id_col: str = "id", text_col: str = "text", min_len: int = MIN_LEN, seed_len: int = SEED_LEN, limits: Limits = Limits()) -> DataFrame:
    """Rows (id, start, end) of removed bytes, not merged; ids must be unique and not null."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") >= min_len)

    found = texts.mapInArrow(trimmed(lambda it: find_blocks(it, min_len, seed_len, limits)), BLOCK_SCHEMA)
    # One shuffle of fixed-width rows: is an anchor hash shared? Rows of which that is known are spread.
    known = (F.col("strings") < 0) | (F.col("start") < 0)
    ranked = (
        found.withColumn("part", F.when(known, F.pmod(F.xxhash64("id", "start"), F.lit(1 << 20))).otherwise(0))
        .withColumn("n", F.count("*").over(Window.partitionBy("anchor", "part")))
        .where((F.col("n") > 1) | known)
        .drop("n", "part")
        .withColumn("start", F.when(F.col("start") < 0, -1 - F.col("start")).otherwise(F.col("start")))
    )
    ranked = saved(ranked)
    local = ranked.where("strings < 0").selectExpr("id", "start", "start - strings as end")
    shared = ranked.where("strings > 0")
    # The earliest place of each block; later ones are repeats as a whole.
    firsts = shared.groupBy("anchor", "whole").agg(F.min(F.struct("id", "start")).alias("first"), F.max("strings").alias("strings"), F.count("*").alias("copies"))
    firsts = saved(firsts)
    again = (
        shared.join(firsts.where("copies > 1").select("anchor", "whole", "first"), ["anchor", "whole"])
        .where("id != first.id or start != first.start")
        .selectExpr("id", "start", f"start + strings + {min_len - 1} as end")
    )
    groups = firsts.groupBy("anchor").agg(F.count("*").alias("blocks")).where("blocks > 1")
    wanted = (
        firsts.join(groups, "anchor")
        .select(F.col("first.id").alias("id"), F.struct("anchor", F.col("first.id").alias("id"), F.col("first.start").alias("start"), "strings", (F.col("blocks") > limits.hot_blocks).alias("hot")).alias("w"))
        .groupBy("id")
        .agg(F.collect_list("w").alias("wanted"))
    )
    cut = texts.join(wanted, "id").select("text", "wanted").mapInArrow(trimmed(lambda it: _cut_blocks(it, min_len, limits)), "anchor long, id long, start long, strings int, block binary")
    searched = cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(lambda it: search_blocks(it, min_len, limits)), SPANS)
    return local.unionByName(again).unionByName(searched)


RESULT = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
)


def _remover(with_text: bool):
    """Column function (text, spans) -> RESULT. What is left of a character cut in two is dropped from
    kept_text; the digest is of all remaining bytes."""

    @F.arrow_udf(RESULT)
    def remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for b, cut in zip(text_bytes(texts), spans.to_pylist()):
            lo, hi = merge(np.array([s["start"] for s in cut or ()], np.int64), np.array([s["end"] for s in cut or ()], np.int64))
            rest = b"".join(b[i:j] for i, j in zip([0, *hi.tolist()], [*lo.tolist(), len(b)])) if len(lo) else b
            rows.append((len(b), len(b) - len(rest), len(lo), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
        cols = list(zip(*rows)) or [()] * 5
        release()
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=RESULT.names)

    return remove


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """docs, and whether its ids are unique, with a unique, not-null ``__key`` in the order that decides which copy is the earlier one.

    Unique ids are their own key. Otherwise (ids repeat or are null) rows rank by id (null last), then by
    a hash of the text; rows equal in both are one document and share a key.
    """
    if unique_key(docs, id_col):
        return docs.withColumn("__key", F.col(id_col).cast("long")), True
    marked = docs.withColumn("__hash", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    ids = marked.select(F.col(id_col).alias("__id"), F.col("__hash").alias("__h")).distinct().orderBy(F.col("__id").asc_nulls_last(), "__h")
    # Sorted rows lie in ranges by partition: this number grows along the order (with gaps, which do no harm).
    ranks = saved(ids.withColumn("__key", F.monotonically_increasing_id()))
    return marked.join(ranks, marked[id_col].eqNullSafe(ranks["__id"]) & (marked["__hash"] == ranks["__h"])).drop("__id", "__h", "__hash"), False


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, with_text: bool = False, limits: Limits = Limits()) -> DataFrame:
    """docs with a struct column ``__dedup``: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and, with_text, kept_text.

    A byte goes if a string of ``min_len`` bytes that covers it also starts earlier: in a document with a
    smaller id, or in the same document at an earlier start; matches never cross documents. Null and empty
    texts: zero bytes, nothing removed. Texts below ``min_len`` bytes stay whole. Empty table: no rows.
    Repeated or null ids: see ``keyed``; a repeated row (same id and text) gets its document's result.
    Other columns, whatever their names, are carried along.
    """
    prepare(docs.sparkSession)
    work, unique = keyed(docs, id_col, text_col)
    one = work if unique else saved(work.select("__key", text_col).dropDuplicates(["__key"]))
    spans = repeated_spans(one, "__key", text_col, min_len, limits=limits).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("__spans")).withColumnRenamed("id", "__key")
    joined = work.join(spans, "__key", "left")
    return joined.withColumn("__dedup", _remover(with_text)(F.col(text_col), F.col("__spans"))).drop("__key", "__spans")
