"""Groups that hold more rows than one task should have: found by counting, cut into intervals or pieces, and put together by summaries.

A key is hot if it has more rows than a shuffle partition's share of all, 1 / spark.sql.shuffle.partitions, and over `LEAST` rows. There
are fewer hot keys than partitions, and a hot key is cut into as many parts as it has shares, so all
lists that reach the driver, and all summaries, have a few rows a partition. Without hot keys the plans are the plain ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups up to this size are left whole.
LEAST = 1000


def shares(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same(a: DataFrame, b: DataFrame, by: list[str], named: str = "") -> Column:
    """Null-safe equality of keys; b's have a prefix."""
    return reduce(Column.__and__, (a[c].eqNullSafe(b[f"{named}{c}"]) for c in by), F.lit(True))


def hot_keys(rows: DataFrame, by: list[str]) -> list[Row]:
    """The hot keys with `__parts`, how many parts each is cut into."""
    if not by:
        return []
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    least = max(LEAST, (total or 0) / shares(rows))
    if not most or most <= least:
        return []
    return counts.where(F.col("__n") > least).withColumn("__parts", F.ceil(F.col("__n") / least)).drop("__n").collect()


def place(cuts: Column, at: Column, most: int) -> Column:
    """How many of the ascending `cuts`, `most` of them at most, are at or below `at`, by halving."""

    def step(acc: Column, bit: Column) -> Column:
        wide = F.call_function("shiftleft", F.lit(1), bit)
        return F.when(F.get(cuts, acc + wide - 1) <= at, acc + wide).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(most.bit_length() - 1), F.lit(0), F.lit(-1)), F.lit(0), step)


def in_intervals(rows: DataFrame, by: list[str], at: str) -> tuple[DataFrame, bool]:
    """rows with `__b`: -1, and for a hot key the number of the interval of `at` (ascending, nulls in the first); and whether there is any hot key.

    The cuts are quantiles of the key's own rows by a sketch, fixed by an action; rows with equal `at` stay together.
    """
    hot = hot_keys(rows, by)
    if not hot:
        return rows.withColumn("__b", F.lit(-1)), False
    spark, most = rows.sparkSession, max(r["__parts"] for r in hot)
    schema = rows.select(*by, F.lit(0).cast("bigint").alias("__parts")).schema
    keys = spark.createDataFrame([(*(r[c] for c in by), r["__parts"]) for r in hot], schema).select(*(F.col(c).alias(f"__k_{c}") for c in by), "__parts")
    # fewer keys than shuffle partitions
    own = rows.select(*by, at).join(F.broadcast(keys), same(rows, keys, by, "__k_"))
    ends = F.array(*(F.lit(i / most) for i in range(1, most)))
    sketch = own.groupBy(*(f"__k_{c}" for c in by), "__parts").agg(F.percentile_approx(at, ends, 100 * most).alias("__ends"))
    # as many of the cuts as the key has parts
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("__parts") - 1), lambda i: F.get("__ends", (i * most / F.col("__parts")).cast("int") - 1)))
    cuts = sketch.where("__parts > 1").select(*(f"__k_{c}" for c in by), F.array_sort(F.array_compact(chosen)).alias("__cuts"))
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)
    # two numbers a shuffle partition at most
    cut = rows.join(F.broadcast(cuts), same(rows, cuts, by, "__k_"), "left")
    b = F.when(F.col("__cuts").isNull(), -1).otherwise(F.coalesce(place(F.col("__cuts"), F.col(at), most), F.lit(0)))
    return cut.withColumn("__b", b).select(*rows.columns, "__b"), True


def summaries(cut: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """A row an interval of each hot key."""
    return cut.where("__b >= 0").groupBy(*by, "__b").agg(*aggregates)


def earlier(by: list[str]) -> Window:
    """Over `summaries`: the key's intervals before the row's."""
    return Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def carried(cut: DataFrame, by: list[str], carry: DataFrame) -> DataFrame:
    """cut with the columns of `carry`, a table made of `summaries`, which has a few rows a shuffle partition."""
    named = carry.withColumnsRenamed({c: f"__k_{c}" for c in (*by, "__b")})
    on = same(cut, named, [*by, "__b"], "__k_")
    return cut.join(F.broadcast(named), on, "left").drop(*(f"__k_{c}" for c in (*by, "__b")))


def running_last(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to and including the row, in the order of `order`, whose first column hot keys are cut by."""
    cut, any_hot = in_intervals(rows.withColumn("__v", value), by, order[0])
    upto = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn(name, F.last("__v", ignorenulls=True).over(upto))
    if any_hot:
        has = F.col("__v").isNotNull()
        ends = summaries(cut, by, F.max_by(F.when(has, F.col("__v")), F.when(has, F.struct(*order))).alias("__end"))
        carry = ends.select(*by, "__b", F.last("__end", ignorenulls=True).over(earlier(by)).alias("__carry"))
        inside = carried(inside, by, carry).withColumn(name, F.coalesce(name, "__carry")).drop("__carry")
    return inside.drop("__b", "__v")


def spread_join(left: DataFrame, right: DataFrame, by: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Left rows with the right rows of their key, nulls included, of which there are few for one key. A hot key's left rows are parted by a hash of `spread`, and its right rows go to each part."""
    hot = hot_keys(left, by)
    parts = F.when(F.lit(False), F.lit(1).cast("bigint"))
    for r in hot:
        parts = parts.when(reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(r[c])) for c in by)), F.lit(r["__parts"]))
    parts = parts.otherwise(F.lit(1).cast("bigint"))
    a = left.withColumn("__part", F.pmod(F.xxhash64(*spread), parts))
    b = right.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).withColumnsRenamed({c: f"__k_{c}" for c in (*by, "__part")})
    return a.join(b, same(a, b, [*by, "__part"], "__k_"), how).drop(*(f"__k_{c}" for c in (*by, "__part")), "__part")
