"""The Jaccard join against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import duckdb

from loomfield.llm import jaccard
from loomfield.llm.queries import SQL

from .conftest import prose


def sets(text):
    w = (text or "").encode().translate(jaccard.ASCII_LOWER).split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(s[i] & s[j])
            if o and 100 * o >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        least[k] = min((x for x in (least.get(k), d) if x is not None), default=None)
    return Counter((d, len(s[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def same(spark, rows):
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_odd_rows(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, jaccard.similar_components(docs).collect())) == brute(rows)
    assert jaccard.similar_components(none).count() == 0


def test_groups_chains_and_boundaries(spark):
    r = random.Random(3)
    rows, shared = [], prose(9, 60)
    for g in range(6):
        base = prose(100 + g, r.randint(6, 90)).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    for g in range(15):  # a passage that many share, with more or less of their own
        rows.append((len(rows), f"{prose(500 + g, 4 + 3 * g)} {shared}"))
    for n in range(1, 12):  # sets of few shingles
        rows += [(len(rows), " ".join(f"s{k}" for k in range(n))), (len(rows) + 1, " ".join(f"S{k}" for k in range(n + 1)))]
    r.shuffle(rows)
    same(spark, rows)


def test_exactly_three_quarters(spark):
    words = [f"v{i}" for i in range(40)]
    # 7 shingles of which 6 are shared by one with 7 (6 of 8), and 3 of 4
    same(spark, [(1, " ".join(words[:11])), (2, " ".join(words[1:12])), (3, " ".join(words[20:27])), (4, " ".join(words[20:28])), (5, " ".join(words[22:28]))])


def test_blocks_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCUMENTS", 4)
    base = prose(77, 40).split()
    r = random.Random(8)
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(40), r.choice((0, 1, 2, 3))):
            w[k] = f"z{i}{k}"
        rows.append((i, " ".join(w)))
    same(spark, rows)


def test_sets_that_share_a_key(spark):
    """With 3 bits of the first hash, sets collide everywhere; the second tells them apart."""
    r = random.Random(6)
    rows = [(i, prose(700 + i // 3, 30) + (" more" if i % 3 == 2 else "")) for i in range(90)]
    r.shuffle(rows)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), set_bits=3)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_common_shingles_and_salted_joins(spark, monkeypatch):
    """Every shared shingle in two classes or more is common, every join parted: the same result."""
    monkeypatch.setattr(jaccard, "HOT_COUNT", 2)
    monkeypatch.setattr(jaccard, "TOGETHER", 2)
    monkeypatch.setattr(jaccard, "BLOCK_DOCUMENTS", 3)
    monkeypatch.setattr(jaccard, "BLOCK_LENGTHS", 200)
    r = random.Random(4)
    rows, passage = [], prose(31, 50)
    for g in range(5):
        base = prose(40 + g, r.randint(20, 60)).split()
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w) + (f" {passage}" if r.random() < 0.5 else "")))
    same(spark, rows)


def test_a_long_chain(spark):
    """Each document is linked with its neighbours only; the component has them all."""
    words = [f"c{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[3 * i : 3 * i + 40])) for i in range(100)]
    same(spark, rows)


def test_templates_with_many_near_misses(spark, monkeypatch):
    """Forms filled from a few words each: nearly all shingles are shared, hardly any pair is linked."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCUMENTS", 8)
    r = random.Random(10)
    fixed = prose(55, 60).split()
    rows = []
    for i in range(400):
        w = [f"{x} {r.choice('abcdefgh')}{k % 4}" if k % 4 == 0 else x for k, x in enumerate(fixed)]
        rows.append((i, " ".join(w)))
    same(spark, rows)


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = jaccard.similar_components(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(SQL["op4_jaccard_join"]).fetchall())
