"""The audit of filters against a plain count, order by order."""

from __future__ import annotations

import re
from itertools import permutations

import pytest

from loomfield.llm import audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id bigint, quality int, toxic int, text string, n int"


def plain(docs: list, labels: list) -> list[tuple]:
    """(part, order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) by going through every order."""
    good = {k for k, q, *_ in labels if q == 1 and k is not None}
    bad = {k for k, _, t, *_ in labels if t == 1 and k is not None}
    rows = []
    for d in docs:
        t = d["text"] or ""
        w = WORDS.findall(t)
        fails = {f for f, c in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t)))) if c}
        if d["doc_id"] is not None and any(x["doc_id"] is not None and x["doc_id"] < d["doc_id"] and (x["text"] or "") == t for x in docs):
            fails.add("E")
        rows.append((d["lang"] or "", fails, d["doc_id"] in good, d["doc_id"] in bad))
    out = []
    for part in {r[0] for r in rows}:
        own, steps, shapley = [r for r in rows if r[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                redundant = sum(f in r[1] for r in own) - len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return out


@pytest.fixture(scope="module")
def labels(spark):
    """Several rows of one id, ids that no document has, nulls, and names that documents have."""
    rows = [(i, i % 2, i % 3 % 2, "x", 1) for i in range(0, 20)] + [(1, 0, 1, None, None), (999, 1, 1, None, None), (None, 1, 1, None, None), (2, None, None, None, None)]
    return spark.createDataFrame(rows, LABELS)


def test_equals_a_plain_count(docs, labels):
    got = sorted(tuple(r) for r in audit.audit(docs, labels).collect())
    assert got == sorted(plain(docs.collect(), [tuple(r) for r in labels.collect()]))
    assert len(got) == 600 * 3


def test_many_equal_texts_and_repeated_keys(spark, labels):
    """A text that half of all rows have, under many keys, one key often, and none; capitals, signs and repetitions in all mixtures."""
    texts = ["a b", "A B " * 120, "one two # " * 80, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)) + " %", ""]
    rows = [(i, "shared", "en", None, None, None, None, None, None, None) for i in range(200)] + [(7, "shared", "de", *[None] * 7)] * 50 + [(None, "shared", None, *[None] * 7)] * 50
    rows += [(1000 + i, texts[i % 6], ("en", "", None)[i % 3], *[None] * 7) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, failed bigint, part string, applied string, quality string, n string, digest string, key string")
    assert sorted(tuple(r) for r in audit.audit(df, labels).collect()) == sorted(plain(df.collect(), [tuple(r) for r in labels.collect()]))


def test_edges_and_orders(spark, docs, none, labels):
    sets, names = audit.failed_sets(docs, labels, audit.failures, "E", "text", "doc_id", "lang")
    assert names == list("ABCDE") and audit.edges(sets, 5).count() == 80 * 3
    assert audit.audit(none, labels).collect() == []
    assert {(r["good_lost"], r["toxic_lost"]) for r in audit.audit(docs, labels.limit(0)).collect()} == {(0, 0)}
    few = audit.audit(docs, labels, filters=lambda t: {"A": t == "one"}, copies="Z")
    assert {r["filter_order"] for r in few.collect()} == {"AZ", "ZA"}
    with pytest.raises(ValueError):
        audit.audit(docs, labels, copies="A")
