"""Token counts by overlap resynchronisation.

Documents of up to `chunk_chars` go to the library whole. A longer one is cut into chunks that
overlap; each chunk is encoded with offsets. Neighbours are spliced at a place in their overlap
that both encodings share and that is proven stable: one of `common.PLACE`, in any script. Every
pre-token ends there, no normaliser step reaches over it, and no special token holds one, so the
tokens on either side don't depend on each other. The tokens from that place to the next such
place must also agree in both chunks; if there is no such place, or they don't agree, the
overlap doubles, at most to the document's end. The proof is of the file's normaliser,
pre-tokenizer and added tokens, which are looked at when it is loaded; with others, and with
sentencepiece, whose pieces may hold blanks, every document goes to the library whole.

Nulls and empty texts have 0 tokens and 0 bytes. Repeated rows stay; an empty table gives an
empty one; only the named columns are read, so other columns may have any names. One document
must fit in a worker's memory; its encodings are held for one chunk at a time.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import PLACE, WORD_PATTERN, released, tokenizer_path, unused

VOCABULARY = "word_bpe_49k.json"
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 128
LIMIT = 2048
NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})

_counters: dict[str, "TokenizerLibrary | PieceLibrary"] = {}


class TokenizerLibrary:
    """tokenizers: .json files."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spliced = proven(json.load(f))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """ids, and where each begins in the text."""
        e = self.t.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets]


class PieceLibrary:
    """sentencepiece: .model files, whole texts only."""

    def __init__(self, path: str):
        import sentencepiece

        self.t = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.t.encode(texts, num_threads=1)]

    spliced = False


def proven(spec: dict) -> bool:
    """Do tokens never depend on what is beyond a place of `common.PLACE`?

    None of NORMALIZERS composes, reorders or changes a character by one beyond white space or full-width punctuation.
    """
    steps = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    normal, pre = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    words = [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}]
    own = [x for x in pre if x["type"] != "ByteLevel"]
    level = [x for x in pre if x["type"] == "ByteLevel"]
    plain = not any(x.get("add_prefix_space") for x in level)
    splits = own == words and not any(x.get("use_regex", True) for x in level) or not own and len(level) == 1 and level[0].get("use_regex", True)
    added = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or not a["content"].isascii() or any(c.isspace() for c in a["content"]) for a in spec.get("added_tokens") or ())
    return plain and splits and added and all(n in NORMALIZERS for n in normal)


def library(path: str):
    """One tokenizer a worker."""
    if path not in _counters:
        _counters[path] = PieceLibrary(path) if path.endswith(".model") else TokenizerLibrary(path)
    return _counters[path]


def splice(lib, text: str, chunk_chars: int, overlap_chars: int) -> tuple[int, int]:
    """(tokens of the text, times an overlap was widened)."""
    total, widened, begin = 0, 0, 0
    size = max(1, chunk_chars)
    end = min(len(text), begin + size)
    ids, starts = lib.tokens(text[begin:end])
    while end < len(text):
        overlap = max(2, overlap_chars)
        while True:
            right = max(begin, end - overlap)
            after = min(len(text), right + max(size, 2 * overlap))
            more, offsets = lib.tokens(text[right:after])
            at = _common(text, begin, right, end, ids, starts, more, offsets)
            if at is not None:
                break
            widened += 1
            if right == begin:  # no proven place in the whole chunk: this longer one replaces it
                at = begin
                break
            overlap *= 2
        total += bisect_left(starts, at - begin)
        kept = bisect_left(offsets, at - right)
        begin, end, ids, starts = at, after, more[kept:], [x - (at - right) for x in offsets[kept:]]
    return total + len(ids), widened


def _common(text: str, begin: int, right: int, end: int, ids: list[int], starts: list[int], more: list[int], offsets: list[int]) -> int | None:
    """The first proven place in the overlap from which to the next one both chunks have the same tokens."""
    last = None
    for m in PLACE.finditer(text, right, end):
        p = m.end()
        if p == end:
            break
        if last is not None:
            a, b = bisect_left(starts, last - begin), bisect_left(starts, p - begin)
            c, d = bisect_left(offsets, last - right), bisect_left(offsets, p - right)
            if ids[a:b] == more[c:d] and [x + begin for x in starts[a:b]] == [x + right for x in offsets[c:d]]:
                return last
        last = p
    return None


def token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, limit: int = LIMIT) -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit, n_widened. No shuffle."""
    path = tokenizer_path(vocabulary)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [x or "" for x in part.column(1).to_pylist()]
                whole = [i for i, t in enumerate(texts) if len(t) <= chunk_chars or not lib.spliced]
                n, widened = [0] * len(texts), [0] * len(texts)
                for i, c in zip(whole, lib.counts([texts[i] for i in whole])):
                    n[i] = c
                for i in set(range(len(texts))) - set(whole):
                    n[i], widened[i] = splice(lib, texts[i], chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(widened, pa.int64())], names=[key, "n_bytes", "n_tokens", "over_limit", "n_widened"])

    return df.select(key, F.col(text).cast("string").alias(unused("text", [key]))).mapInArrow(released(run), f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_widened bigint")
