"""Decontamination against a comparison of all windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomfield.llm import decontaminate as D

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, row bigint, class string, size int"


def words(t: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def plain(docs: list, items: list) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for k, t in items:
        w = words(t)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(k)
    sizes, out = {len(x) for x in windows}, []
    for k, t in docs:
        w, hit, owners = words(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own is not None:
                    hit |= set(range(i, i + size))
                    owners |= {str(x) for x in own if x is not None}
        out.append((k, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return out


def check(df, items) -> list:
    got = D.decontaminate(df, items).collect()
    key = lambda r: tuple(map(str, r))
    want = plain([(r["doc_id"], r["text"]) for r in df.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert all(sum(s["length"] for s in r["spans"]) == r["n_hit"] and all(a["first"] + a["length"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:])) for r in got)
    return got


@pytest.fixture(scope="module")
def items(spark):
    """Passages of the documents, short items, one without words, repeated and missing ids, and names that the operator uses."""
    base = prose(1, 120).split()
    texts = [" ".join(base[20:50]), " ".join(base[45:60]).upper(), " ".join(base[20:29]), "ONE", "two three four", "日本 text with", "", None, " . - ", prose(3, 30_000), " ".join(base[20:50]), prose(77, 40), "x" * 20_000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(0, prose(2, 12), 1, "c", 2), (None, " ".join(base[:12]), 1, "c", 2), (None, prose(5, 12), 1, "c", 2)]
    return spark.createDataFrame(rows, ITEMS)


def test_equals_a_comparison_of_all_windows(docs, items):
    got = check(docs, items)
    assert sum(r["contaminated"] for r in got) > 8


def test_spans_at_any_place_and_of_any_length(spark):
    """Spans of 1 to 30 words of an item, between other words, at both ends, with signs and capitals; of 10 or more all are found."""
    r = random.Random(5)
    item = prose(9, 60).split()
    rows = []
    for n in range(1, 31):
        for k in range(4):
            a = r.randrange(60 - n)
            span = [w.upper() if r.random() < 0.2 else w for w in item[a : a + n]]
            rows.append((len(rows), ", ".join([*prose(1000 + 10 * n + k, 17 * (k % 2)).split(), *span, *prose(2000 + 10 * n + k, 13 * (k // 2)).split()])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = check(df, spark.createDataFrame([(1, " ".join(item), None, None, None)], ITEMS))
    assert all(r["contaminated"] == (r["doc_id"] // 4 + 1 >= 10) for r in got)


def test_a_passage_of_half_the_rows_and_items(spark):
    """The same passage in many documents and many items, with repeated words, and one key for many rows."""
    common = "a b c d e f g h i j k l m n " + "na " * 30
    rows = [(i % 150, f"{prose(i, 6)} {common}") for i in range(200)] + [(None, common)] * 50 + [(5, prose(i, 40)) for i in range(100)]
    items = [(i, f"{common} {prose(i, 10)}", None, None, None) for i in range(60)] + [(100, "na " * 14, None, None, None), (101, "na", None, None, None)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), spark.createDataFrame(items, ITEMS))


def test_a_full_bit_table_changes_nothing(spark, docs, items, monkeypatch):
    monkeypatch.setattr(D.Filter.__init__, "__defaults__", (64,))
    check(docs, items)


def test_fingerprints_are_least_hashes(spark):
    """Every window's fingerprint is the least of its grams' hashes, for all sizes."""
    w = prose(4, 37).split() + ["a"] * 12
    df = spark.createDataFrame([(w,)], "w array<string>")
    gram = lambda a, k: F.xxhash64(*(F.xxhash64(F.lit(x)) for x in w[a : a + k]))
    grams = {k: df.select(*((gram(a, k) if k > 1 else F.xxhash64(F.lit(w[a]))).alias(f"g{a}") for a in range(len(w) - k + 1))).first() for k in range(1, 6)}
    for size in range(1, 13):
        k = min(5, size)
        got = df.select(D.minima(D.hashes_of(F.col("w")), size)).first()[0]
        assert got[: len(w) - size + 1] == [min(grams[k][i : i + size - k + 1]) for i in range(len(w) - size + 1)]


def test_empty_tables(docs, none, items):
    assert D.decontaminate(none, items).collect() == []
    got = D.decontaminate(docs, items.limit(0)).collect()
    assert len(got) == docs.count() and not any(r["contaminated"] or r["n_items"] for r in got)
