"""The grid as bitmaps against the grid itself."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from loomfield.operators import saturation as S

SCHEMA = "participant_ord bigint, participant string, insight string"


def observed(seed: int, orders: list) -> list[tuple]:
    r = random.Random(seed)
    out = [(p, None if p is None else f"P{p}", r.choice(["a", " a ", "b", "c", "d", None])) for p in orders for _ in range(r.randrange(1, 4))]
    return [*out, *out[:5], (None, None, "only they"), (orders[0], f"P{orders[0]}", "rare")]


@pytest.fixture(scope="module")
def rows(spark):
    # on both sides of zero and of the bitmaps' ends
    data = observed(4, [3, -1, 0, 7, 8, 15, 32_767, 32_768, 65_535, 65_536, -32_768, -32_769, 200_000, None])
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def test_row_sums_equal_the_grid(spark, rows):
    grid = Counter((r["insight"], r["mark"]) for r in S.matrix(rows).collect())
    got = {r["insight"]: r for r in S.marks_per_insight(S.bitmaps(rows)).collect()}
    assert set(got) == {i for i, _ in grid} and "only they" in got
    for i, r in got.items():
        assert (r["new"], r["repeat"], r["absent"]) == tuple(grid[i, m] for m in ("NEW", "REPEAT", "ABSENT"))
    firsts = {r["insight"]: r["participant_ord"] for r in S.first_mentions(rows).where("mark = 'NEW'").collect()}
    assert {i: r["first_ord"] for i, r in got.items()} == firsts


@pytest.mark.parametrize("lo, hi", [(-40_000, 300_000), (0, 32_767), (7, 40_000), (9, 12), (-32_769, -1)])
def test_cells_equal_the_grid(spark, rows, lo, hi):
    want = sorted((r["insight"], r["participant_ord"], r["mark"]) for r in S.matrix(rows).where(f"participant_ord BETWEEN {lo} AND {hi}").collect())
    assert sorted(map(tuple, S.cells(S.bitmaps(rows), lo, hi).collect())) == want


def test_counts_and_merged_parts(spark, rows):
    parts = S.bitmaps(rows.where("participant_ord < 100")).unionByName(S.bitmaps(rows.where("participant_ord >= 100 OR participant_ord IS NULL")))
    merged = S.merge_bitmaps(parts, "insight")
    key = lambda df: sorted(map(tuple, df.select("insight", "bucket", "bits").collect()), key=str)
    assert key(merged) == key(S.bitmaps(rows))
    n = {r["insight"]: r["n"] for r in S.people_in(merged.where("insight IS NOT NULL"), "insight").collect()}
    assert n == {r["insight"]: r["n"] for r in S.frequency(rows).collect()}
    assert S.people_in(S.merge_bitmaps(merged)).first()[0] == S.summary(rows).first()["participants"] == 14


def test_empty(spark, rows):
    none = S.bitmaps(rows.limit(0))
    assert S.marks_per_insight(none).count() == 0 and S.cells(none, 0, 10).count() == 0
