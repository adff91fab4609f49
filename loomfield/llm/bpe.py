"""Byte-level BPE by a monoid tree reduction.

The monoid's elements are (text, ids); its product is the encoding of the joined text.
A text is halved down to leaves, each leaf is encoded by itself, and neighbours are joined
by encoding a window around the cut again. The window grows to both sides until it ends at
*hard boundaries*: the places of `common.PLACE`, where every match of the splitting pattern ends
in any context, so tokens outside the window can't change. A stretch without such a place is a
leaf, however long. The proof is of one pattern; with another, a text is one leaf.
Decoding concatenates the leaves' bytes up the same tree.

A long run of white space overflows the stack of the library's pattern (about a million characters). By that pattern a run is one match at a text's end, and else
all of it but its last character is one; so long runs are taken out by this rule and merged without the pattern, with the same ids.

Nulls and empty texts give no ids. Very long texts need memory in proportion to one text.
Equal texts give equal rows; repeated rows stay; an empty table gives an empty one. Only the
named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import BYTE_PATTERN, PLACE, released, tokenizer_path, unused

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 4096
#: White space, as the pattern has it, of this length and more is taken out before the pattern is applied.
LONG_BLANKS = 1024
LONG_RUN = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANKS},}}")
WINDOW_CHARS = 32

_codecs: dict[tuple[str, int, int], "TreeCodec"] = {}


class TreeCodec:
    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars, self.window_chars = max(1, leaf_chars), max(1, window_chars)
        self.proven = public_tokenizers.PATTERN == BYTE_PATTERN
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal_of = {i: str(i) for i in self.bytes_of}

    def leaf(self, text: str) -> list[int]:
        """The ids of a text by itself."""
        if not self.proven or len(text) < LONG_BLANKS or not (runs := [m.span() for m in LONG_RUN.finditer(text)]):
            return self._core.encode_ordinary(text)
        ids, done = [], 0
        for a, b in runs:
            # one match, without its last character where anything follows
            end = b if b == len(text) else b - 1
            ids += self._core.encode_ordinary(text[done:a])
            ids += self._core._encode_single_piece(text[a:end])
            done = end
        return ids + self._core.encode_ordinary(text[done:])

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars or not self.proven or not PLACE.search(text, lo, hi):
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a = self._hard_before(text, lo, mid)
        b = self._hard_after(text, mid, hi)
        dropped, skipped = len(self.leaf(text[a:mid])), len(self.leaf(text[mid:b]))
        del left[len(left) - dropped :]
        left += self.leaf(text[a:b])
        left += right[skipped:]
        return left

    def _hard_before(self, text: str, lo: int, mid: int) -> int:
        """The last hard boundary of text[lo:mid], found in windows that double; lo if it has none."""
        width = self.window_chars
        while True:
            start, last = max(lo, mid - width), None
            for m in PLACE.finditer(text, start, mid):
                last = m.end()
            if last is not None:
                return last
            if start == lo:
                return lo
            width *= 2

    def _hard_after(self, text: str, mid: int, hi: int) -> int:
        """The first hard boundary of text[mid:hi], found in windows that double; hi if it has none."""
        width = self.window_chars
        while True:
            end = min(hi, mid + width)
            if m := PLACE.search(text, mid, end):
                return m.end()
            if end == hi:
                return hi
            width *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def codec(path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS) -> TreeCodec:
    """One codec a worker."""
    key = (path, leaf_chars, window_chars)
    if key not in _codecs:
        _codecs[key] = TreeCodec(*key)
    return _codecs[key]


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS, with_ids: bool = True, with_digests: bool = True) -> DataFrame:
    """Per row: key, n_tokens, the ids themselves and the bytes that they decode to, or digests of these. No shuffle."""
    path = tokenizer_path(vocabulary)
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens bigint" + ", ids array<int>, decoded binary" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf_chars)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out: dict[str, list] = {"n": [], "ids": [], "raw": [], "i": [], "d": []}
                for t in part.column(1):
                    ids = c.encode(t.as_py() or "")
                    raw = c.decode(ids)
                    out["n"].append(len(ids))
                    if with_ids:
                        out["ids"].append(ids)
                        out["raw"].append(raw)
                    if with_digests:
                        out["i"].append(hashlib.sha256(",".join([c.decimal_of[i] for i in ids]).encode()).hexdigest())
                        out["d"].append(hashlib.sha256(raw).hexdigest())
                columns = {key: part.column(0), "n_tokens": pa.array(out["n"], pa.int64())}
                if with_ids:
                    columns |= {"ids": pa.array(out["ids"], pa.list_(pa.int32())), "decoded": pa.array(out["raw"], pa.binary())}
                if with_digests:
                    columns |= {"ids_sha256": pa.array(out["i"], pa.string()), "decoded_sha256": pa.array(out["d"], pa.string())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.select(key, F.col(text).cast("string").alias(unused("text", [key]))).mapInArrow(released(run), schema)
