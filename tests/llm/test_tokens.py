"""BPE, token counts and packing against the libraries."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfield.llm import bpe, packing, tokencount
from loomfield.llm.common import tokenizer_path

ODD = ["a", "'", "'re", "ll", " ", "  ", "\n", "\t", "é", "é", "1", "२", "!", " ", "　", "日本", "the", "\r\n", "x" * 9, "İ", "Σ", "<|endoftext|>", "́", "слово", "。", "，", "か", "\u3099", "한", "\u11a8", "Ⅷ", "²", "\x1c", "\u2028", "\u2000", "t|"]
TEXTS = st.lists(st.sampled_from(ODD), max_size=60).map("".join)


@pytest.fixture(scope="module")
def small_leaves():
    return bpe.TreeCodec(tokenizer_path(bpe.VOCABULARY), 5, 2)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tree_equals_library(small_leaves, text):
    ids = small_leaves.encode(text)
    assert ids == small_leaves.leaf(text)
    assert small_leaves.decode(ids) == text.encode()


@pytest.mark.parametrize("vocabulary", [tokencount.VOCABULARY, "byte_bpe_50k.json"])
@settings(max_examples=300, deadline=None)
@given(text=TEXTS, chunk=st.integers(2, 40), overlap=st.integers(2, 9))
def test_splice_equals_library(vocabulary, text, chunk, overlap):
    lib = tokencount.library(tokenizer_path(vocabulary))
    assert lib.spliced and tokencount.splice(lib, text, chunk, overlap)[0] == lib.counts([text])[0]


def test_other_tokenizers_are_used_whole(tmp_path):
    with open(tokenizer_path(tokencount.VOCABULARY), encoding="utf-8") as f:
        spec = json.load(f)
    assert tokencount.proven(spec)
    for change in ({"normalizer": {"type": "NFD"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Metaspace"}}, {"added_tokens": [spec["added_tokens"][0] | {"content": "a b"}]}):
        assert not tokencount.proven(spec | change)


def test_long_texts_of_any_script_need_no_widening():
    """Work in proportion to the text: no overlap grows, and windows of the tree stay small."""
    lib = tokencount.library(tokenizer_path(tokencount.VOCABULARY))
    c = bpe.codec(tokenizer_path(bpe.VOCABULARY))
    encoded = []
    r = random.Random(2)
    cyrillic = " ".join("".join(r.choice("абвгдежзиклмнопрст") for _ in range(r.randint(2, 9))) for _ in range(30_000))
    chinese = "".join("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(r.randint(2, 20))) + r.choice("，。") for _ in range(8_000))
    for text in (cyrillic, chinese):
        n, widened = tokencount.splice(lib, text, tokencount.CHUNK_CHARS, tokencount.OVERLAP_CHARS)
        assert n == lib.counts([text])[0] and widened == 0
        tree = bpe.TreeCodec(tokenizer_path(bpe.VOCABULARY))
        whole = tree.leaf
        encoded.clear()
        tree.leaf = lambda t: encoded.append(len(t)) or whole(t)  # noqa: B023
        assert tree.encode(text) == c.leaf(text) and sum(encoded) < 1.2 * len(text)


def test_overlap_is_widened_where_nothing_aligns():
    lib = tokencount.library(tokenizer_path(tokencount.VOCABULARY))
    text = "ab cd " * 30 + "x" * 900 + " ef gh" * 40
    n, widened = tokencount.splice(lib, text, 100, 10)
    assert n == lib.counts([text])[0] and widened > 0


def test_encode_rows(spark, docs, none):
    c = bpe.codec(tokenizer_path(bpe.VOCABULARY))
    got = bpe.encode(docs).collect()
    want = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == want
    for r in got:
        text = bytes(r["decoded"]).decode()
        assert r["ids"] == c.leaf(text) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    assert bpe.encode(none).count() == 0


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_count_rows(spark, docs, none, vocabulary):
    lib = tokencount.library(tokenizer_path(vocabulary))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), lib.counts([r["text"] or ""])[0]) for r in docs.collect())
    got = tokencount.token_counts(docs, vocabulary=vocabulary, chunk_chars=3000).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert tokencount.token_counts(none, vocabulary=vocabulary).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_decreasing(lengths):
    rows = packing.best_fit_decreasing(lengths, 30)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    # the plain method: the fullest row that has room, longest pieces first
    room: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [k for k in range(len(room)) if room[k] >= lengths[i]]
        if fits:
            room[min(fits, key=room.__getitem__)] -= lengths[i]
        else:
            room.append(30 - lengths[i])
    assert sorted(30 - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def test_pack_rows(spark, docs, none):
    c = bpe.codec(tokenizer_path(bpe.VOCABULARY))
    parts = defaultdict(list)
    for r in packing.pack(docs, length=64, block_tokens=5000).collect():
        ids, pos = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(pos) == 64 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        assert not ids[r["n_tokens"] :].any()
        for d, offset, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts[d, offset].append(tuple(ids[a:b].tolist()))
    want = defaultdict(list)
    for r in docs.collect():
        for offset, piece in packing.split(c.leaf(r["text"] or ""), 64):
            want[r["doc_id"], offset].append(tuple(piece))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(none).count() == 0


def test_random_texts_of_many_lengths(small_leaves):
    r = random.Random(5)
    for n in (0, 1, 4, 5, 6, 63, 500):
        text = "".join(r.choice(ODD) for _ in range(n))
        assert small_leaves.encode(text) == small_leaves.leaf(text)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", "　", "\x1c "])
def test_long_white_space_equals_library(blank):
    """By rule, with the library's ids, at all lengths that the library itself can do."""
    c = bpe.TreeCodec(tokenizer_path(bpe.VOCABULARY))
    for n in (bpe.LONG_BLANKS - 1, bpe.LONG_BLANKS, bpe.LONG_BLANKS + 1, 5001):
        run = (blank * n)[:n]
        for t in (run, f"a{run}", f"{run}'s b", f"a{run}b{run}7", "ab " * 3000 + run + "cd " * 3000, f"{run}。{'x' * 5000}{run}"):
            ids = c.encode(t)
            assert ids == c._core.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_two_million_blanks(spark):
    """More than the library's pattern can take, alone and between words, through encoding and packing."""
    runs = [(b * 2_000_000)[:2_000_000] for b in (" ", "\n", "\t ", "x")]
    texts = [*runs, *(f"one two{r}three four" for r in runs[:3])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = {r["doc_id"]: r for r in bpe.encode(df, with_ids=False).collect()}
    assert {k: r["decoded_sha256"] for k, r in got.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts)}
    assert packing.pack(df.where("doc_id IN (0, 4)")).agg({"*": "count"}).first()[0] > 0
