"""Packing by power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are powers of two: as many of the sequence
length as fit, then the binary digits of the rest, longest first. A piece is a sequence of its own, so no
sequence crosses documents and none is padded; sequences of equal length form one bucket. Nothing is
shuffled: the work is one pass over the texts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, trimmed

SEQUENCE = 1024
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids array<int>"

#: Below U+0250, the split pattern's character classes are the same in both tokenizer libraries.
UNUSUAL = re.compile("[^\x00-\u024f]").search
_loaded: dict[str, tuple] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str) -> tuple:
    """The tokenizer of a file, its special strings and, for plain byte-level BPE, a faster merge routine on the same
    vocabulary (None for any other file)."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if not plain(spec):
            _loaded[path] = whole, None, list(special)
            return _loaded[path]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = whole, fast, list(special)
    return _loaded[path]


def plain(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE as the faster routine has it: texts as they are, the usual split,
    and merges in the order of the ids that they make."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if spec.get("normalizer") or not usual or model.get("type") != "BPE" or any(odd):
        return False
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in made and all(a < b for a, b in zip(made, made[1:]))


def encode(text: str, path: str) -> np.ndarray:
    """Token ids as the tokenizer at ``path`` gives them, without added special tokens.

    Texts of plain letters take a faster implementation of the same merges; a text with other characters or
    with a special string goes through the tokenizer itself.
    """
    whole, fast, special = _load(path)
    if fast and not UNUSUAL(text) and not any(s in text for s in special):
        return np.frombuffer(array("I", fast.encode_ordinary(text)), np.uint32)
    return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)


def lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Piece lengths of a document of n tokens: full sequences, then falling powers of two."""
    rest = n % sequence
    return [sequence] * (n // sequence) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def _pack(path: str, end_id: int, sequence: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            rows: list[tuple] = []
            for i, text in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
                ids = np.append(encode(text, path) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in lengths(len(ids), sequence):
                    part = ids[start : start + n]
                    rows.append((i, start, n, zlib.crc32(part.tobytes()), len(ids), n.bit_length() - 1, part.astype(np.int32) if with_ids else None))
                    start += n
                if len(rows) > 20000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return pack


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the
    length) and, with_ids, the ids.

    Null and empty texts: one piece that holds the end id. Repeated rows and null ids: each row is a document
    of its own, with sequences of its own. Other columns are ignored; empty table: no rows. sequence must be a
    power of two. sequence_id is unique and depends on the input's partitions only.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    prepare(docs.sparkSession)
    path = vocabulary or tokenizer_path(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(trimmed(_pack(path, end_id, sequence, with_ids)), PIECES)
    out = rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    return out.select(*cols, *["ids"] * with_ids)
