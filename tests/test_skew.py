"""Groups with a third of all rows and more are cut, with the results of the plain windows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomfield.operators import clean as C
from loomfield.operators import questionnaire as Q
from loomfield.operators import relational as R
from loomfield.operators import skew


@pytest.fixture(params=[20, 1000], ids=["cut", "whole"])
def least(request, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", request.param)


def rows(n: int = 900) -> list[tuple]:
    """Half of them one user's, a fifth without a user; many at equal times, two runs of hours without any."""
    r = random.Random(3)
    start = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        user = 7 if i % 2 else (None if i % 5 == 0 else r.randrange(20))
        at = start + timedelta(minutes=r.choice([0, 3000, 9000]) + r.randrange(0, 1200, 7))
        out.append((i, user, at, r.choice(["view", "purchase"])))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id bigint, user_id bigint, ts timestamp_ntz, kind string").repartition(5)


def test_intervals_hold_a_share(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 20)
    df = spark.createDataFrame([(7 if i % 2 else i, i % 331) for i in range(4000)], "k bigint, t bigint")
    cut, any_hot = skew.in_intervals(df, ["k"], "t")
    assert any_hot
    got = cut.groupBy("k", "__b").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("k = 7").orderBy("__b").collect()
    assert len(got) == 2 and max(r["n"] for r in got) <= 1100 and all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))
    assert [r[0] for r in cut.where("k <> 7").select("__b").distinct().collect()] == [-1]


def test_place(spark):
    got = spark.range(-1, 12).select("id", skew.place(F.array(*map(F.lit, [1, 3, 4, 8])), F.col("id"), 5).alias("p")).collect()
    assert all(r["p"] == sum(c <= r["id"] for c in (1, 3, 4, 8)) for r in got)


def test_asof(spark, least):
    data = rows()
    left = frame(spark, [x for x in data if x[3] == "purchase"])
    views = frame(spark, [x for x in data if x[3] == "view"]).groupBy("user_id", "ts").agg(F.max("id").alias("view_id"))
    got = R.asof_join(left.select("id", "user_id", "ts"), views, ["user_id"], "ts", ["view_id"]).collect()
    for r in got:
        before = [(x[2], x[0]) for x in data if x[3] == "view" and x[1] == r["user_id"] and x[2] < r["ts"]]
        assert r["last_view_id"] == (max(before)[1] if before else None)
    assert len(got) == left.count()


@pytest.mark.parametrize("gap", [60, 1800, 100_000, 10**7])
def test_sessions(spark, least, gap):
    data, want = rows(), []
    for user in {x[1] for x in data}:
        own = sorted(x[2] for x in data if x[1] == user)
        at = [0] + [i for i in range(1, len(own)) if (own[i] - own[i - 1]).total_seconds() > gap] + [len(own)]
        want += [(user, own[a], own[b - 1], b - a) for a, b in zip(at, at[1:])]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, R.sessions(frame(spark, data), "user_id", "ts", gap).collect()), key=key) == sorted(want, key=key)


def test_fill_and_replies(spark, least):
    data = [(7 if i % 2 else i % 11, i, ("user", "assistant", "other")[i * i % 7 % 3], f"t{i}") for i in range(800)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    filled = {(r["conv_id"], r["turn"]): r["h"] for r in Q.fill_forward(df, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "h").collect()}
    replies = {(r["conv_id"], r["turn"]): r["reply"] for r in Q.reply_pairs(df).collect()}
    want_fill, want_reply = {}, {}
    for c in {x[0] for x in data}:
        last, own = None, [x for x in data if x[0] == c]
        for x, after in zip(own, [*own[1:], None]):
            last = x[3] if x[2] == "user" else last
            want_fill[c, x[1]] = last
            if x[2] == "user":
                want_reply[c, x[1]] = after[3] if after and after[2] == "assistant" else None
    assert filled == want_fill and replies == want_reply


def test_half_of_a_table_equal(spark, least):
    data = [(i, "same" if i % 2 else f"v{i % 30}", None if i % 10 else "  ") for i in random.Random(1).sample(range(1000), 1000)]
    data = [(i, a if i % 9 else None, b) for i, a, b in data]
    df = spark.createDataFrame(data, "row_idx bigint, a string, b string").repartition(6)
    seen, first, want = {}, {}, {}
    for i, a, b in sorted(data):
        key = i if a is None and not (b or "").strip() else (a, b)
        first.setdefault(key, i)
        seen[key] = seen.get(key, 0) + 1
        want[i] = (seen[key], first[key])
    assert {r["row_idx"]: (r["occurrence"], r["retained"]) for r in C.duplicates(df, ["a", "b"]).collect()} == want
    kept = C.keep_first(df, ["a", "b"])
    assert kept.columns == df.columns and {r["row_idx"] for r in kept.collect()} == {i for i, (n, _) in want.items() if n == 1}
    assert {tuple(r) for r in C.removed(df, ["a", "b"]).collect()} == {(i, f) for i, (n, f) in want.items() if n > 1}


def test_spread_join(spark, least):
    left = spark.createDataFrame([(i, 7 if i % 2 else (None if i % 5 == 0 else i % 40)) for i in range(600)], "id bigint, k bigint")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (None, "n"), *[(i, f"r{i}") for i in range(20, 60)]], "k bigint, v string")
    got = sorted(((r["id"], r["v"]) for r in skew.spread_join(left, right, ["k"], ["id"], "left").collect()), key=str)
    known = [tuple(r) for r in right.collect()]
    want = [(r["id"], v) for r in left.collect() for v in ([v for k, v in known if k == r["k"]] or [None])]
    assert got == sorted(want, key=str)


def test_only_differing_buckets_are_compared(spark):
    rows = [(i, f"v{i % 50}", None if i % 9 else 0.5) for i in range(3000)] + [(1, "twice", None)] * 3 + [(None, None, None)] * 2
    a = spark.createDataFrame(rows, "k bigint, v string, x double")
    b = spark.createDataFrame([r for r in rows if r[0] != 17][:-1] + [(5, "new", 0.25), (1, "twice", None)], "k2 bigint, v string, x double").repartition(5)
    got = sorted((str(tuple(r)[:3]), r["side"]) for r in R.set_difference(a, b).collect())
    assert got == sorted([(str((17, "v17", None)), "left"), (str((None, None, None)), "left"), (str((5, "new", 0.25)), "right"), (str((1, "twice", None)), "right")])
    assert [x.count() < 40 for x in R.differing(a, b)] == [True, True]
    assert R.set_difference(a, a.repartition(3)).count() == 0 and [x.count() for x in R.differing(a, a.orderBy("v"))] == [0, 0]
    assert R.set_difference(a, a.limit(0)).count() == len(rows) and R.set_difference(a.limit(0), a.limit(0)).count() == 0
    assert R.set_difference(a.select("k"), a.select(F.col("k").cast("int"))).count() == 0
