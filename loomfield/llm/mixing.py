"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of a budget of words. Sources that would be repeated more
than `max_epochs` times are clamped there, the rest is shared anew by weight, until none is
above: the water level is found by rounds of one aggregation over the table of sources.

A target of w + f times a source's size means w whole repetitions and a fraction f of the next:
a seeded subset of its documents, or where f is over a half, all but a seeded subset. Documents
are ordered by a seeded hash of key and text; the subset is the longest run from the start that
fits, then the longest run of documents that still fit into what is missing, and so on, until
less than `CLOSE` of the target is missing, at most `RUNS` times. Each run is given by a size
limit and a last hash, found from sums over hash buckets and one bucket's rows, so no task sees
a whole source.

The default weights are 5, 2, 1, repeating over the sources by code point, null last. Null text
has size 0 and is repeated as its source is, whole times only. Rows equal in key and text share a
hash and are taken or left together; rows without a key, or with another row's, are told apart
by their texts. A very long text is one row like any other: if it doesn't fit into what is
missing, it isn't in the subset. An empty table gives an empty one. Columns of any names pass through,
as the fields of `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.llm.common import WORD, Workspace
from loomfield.llm.ranking import global_rank

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = 17
BUCKETS = 4096
RUNS = 6
CLOSE = 0.002


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(work: Workspace, rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, of rows (source, size)."""
    sizes = work.save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    ranked = global_rank(work, sizes, [F.col("source").asc_nulls_last()], "ranked")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    table = work.save(ranked.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget, level, clamped = total * percent / 100, 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("cap")
        s = table.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count(F.when(above, 1))).first()
        if s[2] == clamped or not s[1]:
            break
        clamped, level = s[2], (budget - s[0]) / s[1]
    return table.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """row: df's columns; mix: size, source_size, target, copies."""
    work = Workspace(df.sparkSession, "mix")
    order = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text).cast("string"))
    rows = work.save(df.select(F.col(source).cast("string").alias("source"), size_of(text).alias("size"), order.alias("u")), "rows")
    rows = rows.withColumn("bucket", F.pmod("u", F.lit(BUCKETS)).cast("int"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = targets(work, rows, weights, percent, max_epochs).withColumn("whole", whole)
    part = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint")
    plan = plan.withColumn("part", part).withColumn("left_out", F.col("part") * 2 > F.col("source_size"))
    plan = plan.withColumn("part", F.when(F.col("left_out"), F.col("source_size") - F.col("part")).otherwise(F.col("part")))
    plan = plan.withColumns({"need": F.col("part"), "runs": F.array().cast("array<struct<most:bigint,bucket:int,u:bigint>>")})
    fixed = ("source", "source_size", "target", "whole", "left_out", "part")
    plan = work.save(plan, "plan-0")
    for k in range(1, RUNS + 1):
        left = plan.agg(F.max(F.when(F.col("target") > 0, F.col("need") / F.col("target")).otherwise(0))).first()[0]
        if not left or left <= CLOSE:
            break
        fit = rows.join(plan.where("need > 0").select(F.col("source").alias("s"), "need", "runs"), F.col("source").eqNullSafe(F.col("s"))).where((F.col("size") > 0) & (F.col("size") <= F.col("need")) & ~_taken("size", "bucket", "u"))
        sums = fit.groupBy("s", "bucket").agg(F.sum("size").alias("size"), F.first("need").alias("need"))
        run = F.sum("size").over(Window.partitionBy("s").orderBy("bucket"))
        edge = sums.withColumn("run", run).where("run > need").groupBy("s").agg(F.min_by(F.struct("bucket", (F.col("run") - F.col("size")).alias("before")), "bucket").alias("edge"))
        edge = work.save(edge, f"edge-{k}")
        inside = fit.join(edge.select(F.col("s").alias("s2"), "edge"), F.col("s").eqNullSafe(F.col("s2"))).where("bucket = edge.bucket")
        # rows with one hash go together: a range frame
        upto = F.sum("size").over(Window.partitionBy("s").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        last = inside.withColumn("upto", upto).where("edge.before + upto <= need").groupBy("s").agg(F.max("u").alias("u"))
        e, z = edge.select(F.col("s").alias("se"), "edge"), last.select(F.col("s").alias("sz"), "u")
        # without an edge everything fits
        new = F.struct(F.col("need").alias("most"), F.coalesce("edge.bucket", F.lit(BUCKETS)).alias("bucket"), F.coalesce("u", F.lit(-(2**63))).alias("u"))
        planned = plan.join(e, F.col("source").eqNullSafe(F.col("se")), "left").join(z, F.col("source").eqNullSafe(F.col("sz")), "left").withColumn("runs", F.when(F.col("need") > 0, F.concat("runs", F.array(new))).otherwise(F.col("runs")))
        planned = work.save(planned.select(*fixed, "need", "runs"), f"planned-{k}")
        got = rows.join(planned.select(F.col("source").alias("s"), "runs"), F.col("source").eqNullSafe(F.col("s"))).where(_taken("size", "bucket", "u")).groupBy("s").agg(F.sum("size").alias("got"))
        left_over = F.col("part") - F.coalesce("got", F.lit(0))
        plan = work.save(planned.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("need", left_over).select(*fixed, "need", "runs"), f"plan-{k}")
    work.drop("rows", *(f"{name}-{i}" for i in range(1, k + 1) for name in ("edge", "planned")), *(f"plan-{i}" for i in range(k - 1)))
    plan = plan.select(F.col("source").alias("s"), F.struct("source_size", "target", "whole", "left_out", "runs").alias("plan"))
    named = df.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"), order.alias("u"))
    joined = named.withColumn("bucket", F.pmod("u", F.lit(BUCKETS)).cast("int")).join(plan, F.col("source").eqNullSafe(F.col("s")))
    once_more = (_taken("size", "bucket", "u", "plan.runs") != F.col("plan.left_out")) & (F.col("size") > 0)
    copies = F.col("plan.whole") + F.when(once_more, 1).otherwise(0)
    return joined.select("row", F.struct("size", "plan.source_size", "plan.target", copies.alias("copies")).alias("mix"))


def _taken(size: str, bucket: str, u: str, runs: str = "runs") -> Column:
    """Does the row belong to any of its source's runs?"""
    inside = lambda r: (F.col(size) <= r["most"]) & ((F.col(bucket) < r["bucket"]) | ((F.col(bucket) == r["bucket"]) & (F.col(u) <= r["u"])))
    return F.exists(F.col(runs), inside)


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: df's columns, each row as often as it was taken."""
    return mixed.where("mix.copies > 0").select("row", F.explode(F.expr("sequence(1, mix.copies)"))).select("row.*")
