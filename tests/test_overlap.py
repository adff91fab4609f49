"""Ranges that overlap, against all pairs: points, long ranges, nulls, hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomfield.operators import relational as R
from loomfield.operators import skew


def ranges(seed: int, n: int, key: bool = True) -> list[tuple]:
    """A third of one key; points, short ranges, some as long as everything, some backwards, some without an end or a key."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lo = r.randrange(-500, 500)
        hi = lo + r.choice([0, 0, 3, 11, 40, 900, -2])
        out.append((i, None if i % 17 == 0 else "hot" if i % 3 == 0 else f"k{r.randrange(5)}", None if i % 23 == 0 else lo, None if i % 29 == 0 else hi))
    return out


def overlapping(a, b, by: bool):  # noqa: ANN001, ANN201
    whole = lambda x: None not in x[2:] and x[2] <= x[3] and (not by or x[1] is not None)
    return sorted((x[0], y[0]) for x in a if whole(x) for y in b if whole(y) and (not by or x[1] == y[1]) and x[2] <= y[3] and y[2] <= x[3])


@pytest.mark.parametrize("width", [1.0, 10.0, 5000.0])
@pytest.mark.parametrize("by", [(), ("k",)])
@pytest.mark.parametrize("least", [20, 1000])
def test_equals_all_pairs(spark, monkeypatch, width, by, least):
    monkeypatch.setattr(skew, "LEAST", least)
    a, b = ranges(1, 150), ranges(2, 120)
    l = spark.createDataFrame(a, "i bigint, k string, lo bigint, hi bigint")
    r = spark.createDataFrame(b, "j bigint, k string, from bigint, to bigint")
    l, r = (l, r) if by else (l.drop("k"), r.drop("k"))
    got = R.overlap_join(l, r, ("lo", "hi"), ("from", "to"), width, by)
    assert sorted((x["i"], x["j"]) for x in got.select("i", "j").collect()) == overlapping(a, b, bool(by))


def test_repeated_rows_and_empty_tables(spark):
    l = spark.createDataFrame([(1, 0.5, 2.5)] * 2, "i int, lo double, hi double")
    r = spark.createDataFrame([(9, 2.5, 7.0)] * 3, "j int, from double, to double")
    assert R.overlap_join(l, r, ("lo", "hi"), ("from", "to"), 1.0).count() == 6
    assert R.overlap_join(l.limit(0), r, ("lo", "hi"), ("from", "to"), 1.0).count() == 0
    assert R.overlap_join(l, r.limit(0), ("lo", "hi"), ("from", "to"), 1.0).count() == 0
    with pytest.raises(ValueError, match="lo"):
        R.overlap_join(l, l, ("lo", "hi"), ("lo", "hi"), 1.0)


def test_cells_are_the_range(spark):
    """Each leaf of the range is in one cell, and a long range has few of them."""
    pairs = [(a, a + n) for a in (-70, -8, -1, 0, 5, 64) for n in (0, 1, 7, 8, 63, 64, 700)]
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", R.covering(F.col("a"), F.col("b"), F.sequence(F.lit(0), F.lit(4))).alias("c")).collect()
    for x in got:
        leaves = sorted(leaf for c in x["c"] for leaf in range(c["cell"] * 8 ** c["level"], (c["cell"] + 1) * 8 ** c["level"]))
        assert leaves == list(range(x["a"], x["b"] + 1)) and len(x["c"]) <= 56
