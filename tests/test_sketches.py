"""Merged sketches against the rows that they stand for."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomfield.operators import sketches as K


def test_merged_twice_and_odd_groups(spark, tmp_path):
    r = random.Random(1)
    rows = [("ab"[i % 2], i % 30, r.randrange(3000), r.gauss(0, 1)) for i in range(12_000)] + [("n", 1, None, None)] * 3 + [(None, 2, 5, float("nan")), (None, 2, 5, 2.0)]
    df = spark.createDataFrame(rows, "k string, day int, user int, v double").repartition(6)
    K.build(df, ["day", "k"], "user", "v").write.parquet(str(tmp_path / "days"))
    weeks = K.merge(spark.read.parquet(str(tmp_path / "days")).withColumn("week", F.floor(F.col("day") / 7)), ["week", "k"])
    got = {x["k"]: x for x in K.estimates(K.merge(weeks, ["k"]), (0.1, 0.5, 1.0)).collect()}
    for k in "ab":
        own = sorted(v for a, _, _, v in rows if a == k)
        users = len({u for a, _, u, _ in rows if a == k})
        assert got[k]["n"] == got[k]["n_values"] == 6000 and abs(got[k]["about"] - users) < 0.06 * users
        assert all(abs(sum(v <= q for v in own) / 6000 - p) < 0.02 for q, p in zip(got[k]["q"], (0.1, 0.5, 1.0)))
    assert (got["n"]["n"], got["n"]["about"], got["n"]["q"]) == (3, 0, None)
    assert (got[None]["n"], got[None]["about"], got[None]["q"]) == (2, 1, [2.0, 2.0, 2.0])
    assert K.merge(K.build(df.limit(0), ["k"], "user", "v"), ["k"]).count() == 0
