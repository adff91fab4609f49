"""Quotes of any length against a comparison of all pairs; and rows without a group, a participant or an insight."""

from __future__ import annotations

import random

import pytest

from loomfield.operators import profile as P
from loomfield.operators import questionnaire as Q
from loomfield.operators import saturation as S


def test_quotes_of_any_length(spark):
    r = random.Random(2)
    words = ["ab", "b", "abc", "é", "the", "", "日本", "x" * 300]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "the"), (1, "twice under one key the ab")]
    quotes = [(k, " ".join(r.choice(words) for _ in range(1 + k % 10))) for k in range(120)]
    quotes += [(k + 500, t[a : a + 3 + k]) for k, (_, t) in enumerate(texts[:40]) for a in [len(t) // 3]] + [(900, None), (901, ""), (902, "the"), (903, "the"), (902, "b")]
    got = Q.evidence(spark.createDataFrame(texts, "doc int, text string").repartition(3), spark.createDataFrame(quotes, "item string, quote string"), "text", "quote", "doc", "item")
    want = {(d, str(k)) for d, t in texts for k, q in quotes if t is not None and q is not None and q in t}
    assert {tuple(x) for x in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [300, 10**6])
def test_blocks_of_quotes(spark, block):
    texts = [(i, f"w{i} v{i % 7} end") for i in range(30)]
    quotes = [(k, f"v{k}") for k in range(9)] + [(9, "w1"), (10, "")]
    frames = spark.createDataFrame(texts, "doc int, text string"), spark.createDataFrame(quotes, "item int, quote string")
    got = sorted(tuple(x) for x in Q.short_evidence(*frames, "text", "quote", "doc", "item", block_bytes=block).collect())
    assert got == sorted((d, k) for d, t in texts for k, q in quotes if q in t)
    assert Q.short_evidence(frames[0], frames[1].limit(0), "text", "quote", "doc", "item").collect() == []


def test_outliers_of_a_null_group_and_nan(spark):
    nan = float("nan")
    rows = [(g, v) for g in (None, "a") for v in (1.0, 2.0, 3.0, 4.0, 5.0, 1000.0)] + [("n", v) for v in (nan,) * 5 + (1.0, 1.0, 1.0, 1.0, None)] + [("all", nan)] * 4
    got = {r["g"]: r for r in P.outliers(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got[None]["flagged"] == got["a"]["flagged"] == 1 and got[None]["q1"] == got["a"]["q1"]
    assert (got["n"]["n"], got["n"]["flagged"], got["n"]["q3"]) == (4, 0, 1.0)
    assert got["all"]["state"] == "insufficient_data" and got["all"]["n"] == 0


def test_participants_and_insights_without_a_value(spark):
    rows = [(1, "ann", "x"), (2, "bob", "x"), (None, "cat", "x"), (None, "cat", "y"), (None, "dan", "y"), (3, "eve", None), (2, None, "z"), (2, "bob", "z")]
    obs = spark.createDataFrame(rows, "participant_ord int, participant string, insight string")
    marks = {(r["insight"], r["participant"], r["participant_ord"]): r["mark"] for r in S.matrix(obs).collect()}
    people = [("ann", 1), ("bob", 2), ("cat", None), ("dan", None), ("eve", 3), (None, 2)]
    new = {("x", "ann"), ("y", "cat"), ("y", "dan"), ("z", None), ("z", "bob")}
    said = {(i, p) for _, p, i in rows if i}
    assert marks == {(i, p, o): "NEW" if (i, p) in new else "REPEAT" if (i, p) in said else "ABSENT" for i in "xyz" for p, o in people}
    assert {(r["participant"], r["new_insights"]) for r in S.new_per_participant(obs).collect()} == {("ann", 1), ("bob", 1), ("cat", 1), ("dan", 1), ("eve", 0), (None, 1)}
    assert {(r["insight"], r["n"], r["share"]) for r in S.frequency(obs).collect()} == {("x", 3, 0.75), ("y", 1, 0.25), ("z", 1, 0.25)}
    assert tuple(S.summary(obs).first())[:2] == (3, 4)
    empty = obs.limit(0)
    assert S.matrix(empty).collect() == [] and tuple(S.summary(empty).first()) == (0, 0, None)
