"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is tried: those that the tokenizer leaves as one token are proven
whole. A text is cut into pre-tokens at borders that no vocabulary string crosses, so the counts of its
pre-tokens add up to its own. Pre-tokens that are proven whole count one each; only the rest is merged by
the library, and remembered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: Merged pre-tokens that a worker remembers before it starts anew, and their most characters.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 64
_counters: dict[str, Counter] = {}


class Counter:
    """Counts of one sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        strings = [self.model.id_to_piece(i) for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        # No string continues with a space after another character, and none holds a line feed: both are borders.
        # Otherwise, or if spaces are not kept one by one, texts are counted whole.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}|\n", s) for s in strings) and self._spaces_kept()
        self.whole = dict.fromkeys(self._proven(strings), 1) if self.cuts else {}
        self.known = dict(self.whole)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall

    def _spaces_kept(self) -> bool:
        probe = self.model.encode("  a  b\n c  ", out_type=str)
        return "".join(p if p != "<0x0A>" else "\n" for p in probe) == f"{SPACE * 3}a{SPACE * 2}b\n{SPACE}c{SPACE * 2}"

    def _proven(self, strings: list[str]) -> list[str]:
        counts = self._merged(strings)
        return [s for s, n in zip(strings, counts) if n == 1]

    def _merged(self, tokens: list[str]) -> list[int]:
        """Tokens of pre-tokens, merged by the library. One that starts with a space takes the library's own
        leading space; before others stands a line feed, which costs two tokens with that space."""
        led = [t[0] == SPACE for t in tokens]
        out = self.model.encode([t[1:] if s else "\n" + t for t, s in zip(tokens, led)], num_threads=1) if tokens else []
        return [(1 if len(t) == 1 else len(x)) if s else len(x) - 2 for t, x, s in zip(tokens, out, led)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.model.encode(text))
        tokens = self.cut(SPACE + text.replace(" ", SPACE))
        try:
            return sum(map(self.known.__getitem__, tokens))
        except KeyError:
            pass
        known = self.known
        rest = [t for t in dict.fromkeys(tokens) if t not in known]
        if len(known) + len(rest) > REMEMBERED + len(self.whole):
            known = self.known = dict(self.whole)
            rest = [t for t in dict.fromkeys(tokens) if t not in known]
        new = dict(zip(rest, self._merged(rest)))
        known.update((t, n) for t, n in new.items() if len(t) <= LONGEST_REMEMBERED)
        return sum(known[t] if t in known else new[t] for t in tokens)


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, as the library gives them for the whole text.

    Null and empty texts: zero bytes and tokens. Null ids and repeated rows are returned as given. Other
    columns are ignored; empty table: no rows.
    """
    import public_tokenizers

    prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf(T.LongType())
    def tokens(texts: pa.Array) -> pa.Array:
        use = counter(path)
        return pa.array(np.array([use.count(t) if t else 0 for t in texts.to_pylist()], np.int64))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
