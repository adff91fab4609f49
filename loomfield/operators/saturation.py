"""Insight saturation: who was first with which insight, and when nothing new came any more.

Observations are (participant_ord, participant, insight); an insight mentioned twice by one
participant counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 65_536
#: Participants of a block of the grid, and parts of the insights that a block goes to.
PEOPLE_BLOCK = 4096
GRID_PARTS = 16


def first_mentions(observations: DataFrame) -> DataFrame:
    """One row per insight and participant, with `mark` NEW for the insight's first participant and REPEAT after.

    Participants without an order come last and are all as late as one another, as in `curve`. An observation without an insight has none: its mark is null.
    """
    seen = observations.select("participant_ord", "participant", F.trim("insight").alias("insight")).distinct()
    first = seen.groupBy("insight").agg(F.min("participant_ord").alias("first_ord"))
    joined = seen.join(first.where("insight IS NOT NULL"), "insight", "left")
    # the least is null only if all are
    is_first = F.col("participant_ord").eqNullSafe(F.col("first_ord"))
    return joined.withColumn("mark", F.when(F.col("insight").isNull(), F.lit(None)).when(is_first, "NEW").otherwise("REPEAT")).drop("first_ord")


def participants(observations: DataFrame) -> DataFrame:
    return observations.select("participant_ord", "participant").distinct()


def matrix(observations: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Every insight with every participant of `people`: (insight, participant_ord, participant, mark), ABSENT where not mentioned.

    The grid is what is asked for: its size is insights x participants. Participants go in blocks of
    about PEOPLE_BLOCK, each block to GRID_PARTS parts of the insights, and meet them by an equi-join
    on block and part, so no task has a whole side; the number of participants is counted first.
    """
    marks = first_mentions(observations).where("insight IS NOT NULL")
    people = (participants(observations) if people is None else people.select("participant_ord", "participant")).distinct()
    blocks = 1 + people.count() // PEOPLE_BLOCK
    block = F.pmod(F.xxhash64("participant_ord", "participant"), F.lit(blocks)).alias("__block")
    packed = people.groupBy(block).agg(F.collect_list(F.struct("participant_ord", "participant")).alias("__people"))
    packed = packed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1))))
    insights = marks.select("insight").distinct().withColumn("__part", F.pmod(F.xxhash64("insight"), F.lit(GRID_PARTS)).cast("int"))
    insights = insights.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    grid = insights.join(packed, ["__block", "__part"]).select("insight", F.explode("__people").alias("p")).select("insight", "p.participant_ord", "p.participant")
    # a participant is known by order and name, either of which may be missing
    own = marks.select(F.col("insight").alias("__i"), F.col("participant_ord").alias("__o"), F.col("participant").alias("__p"), "mark")
    on = (grid["insight"] == own["__i"]) & grid["participant_ord"].eqNullSafe(own["__o"]) & grid["participant"].eqNullSafe(own["__p"])
    return grid.join(own, on, "left").select("insight", "participant_ord", "participant", F.coalesce("mark", F.lit("ABSENT")).alias("mark"))


def matrix_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """For display: one column per participant, in the order given."""
    return long.groupBy("insight").pivot("participant", names).agg(F.first("mark"))


def new_per_participant(observations: DataFrame) -> DataFrame:
    """(participant_ord, participant, new_insights), zeros kept."""
    return first_mentions(observations).groupBy("participant_ord", "participant").agg(F.count(F.when(F.col("mark") == "NEW", 1)).alias("new_insights"))


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running sum of `value` by a whole-number column, in two levels: within chunks of its range, and over the chunks' sums. No task sees all rows. A null order is last, as in the query's SQL."""
    cut = rows.withColumn("__chunk", F.floor(F.col(order) / CHUNK))
    sums = cut.groupBy("__chunk").agg(F.sum(value).alias("__sum"))
    before = sums.select(F.col("__chunk").alias("__of"), (F.sum("__sum").over(Window.orderBy(F.asc_nulls_last("__chunk"))) - F.col("__sum")).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(before, F.col("__chunk").eqNullSafe(F.col("__of"))).withColumn(name, inside + F.col("__before")).drop("__chunk", "__of", "__before")


def curve(observations: DataFrame) -> DataFrame:
    """New and cumulative insights in participant order."""
    return running_total(new_per_participant(observations), "participant_ord", "new_insights", "total_insights")


def frequency(observations: DataFrame) -> DataFrame:
    """Participants mentioning each insight, and their share of all."""
    seen = observations.select("participant_ord", F.trim("insight").alias("insight")).distinct()
    total = seen.select("participant_ord").distinct().agg(F.count("*").alias("total"))
    return seen.where("insight IS NOT NULL").groupBy("insight").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("insight", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def summary(observations: DataFrame) -> DataFrame:
    """Totals, and the last participant with anything new."""
    m = first_mentions(observations)
    people = F.count_distinct("participant_ord") + F.max(F.col("participant_ord").isNull().cast("bigint"))
    return m.agg(F.count_distinct("insight").alias("insights"), F.coalesce(people, F.lit(0)).cast("bigint").alias("participants"), F.max(F.when(F.col("mark") == "NEW", F.col("participant_ord"))).alias("last_new_ord"))


def summary_mismatch(bullets: DataFrame, observations: DataFrame) -> DataFrame:
    """Insights that only the summary bullets or only the observations have."""
    a, b = bullets.select("insight").distinct().withColumn("in_summary", F.lit(True)), observations.select(F.trim("insight").alias("insight")).distinct().withColumn("in_matrix", F.lit(True))
    return a.join(b, "insight", "full_outer").where("in_summary IS NULL OR in_matrix IS NULL").select("insight", F.coalesce("in_summary", F.lit(False)).alias("in_summary"), F.coalesce("in_matrix", F.lit(False)).alias("in_matrix"))


# --- the grid as bitmaps ---------------------------------------------------------------------------

#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32_768


def bitmaps(observations: DataFrame) -> DataFrame:
    """(insight, bucket, bits): who mentions an insight, a bit for each participant_ord, BITMAP orders a row. Bucket null: somebody without an order does.

    The grid at a bit a cell, for buckets with a mark only; orders are whole numbers, and stand for the participants alone. Bitmaps of parts of the
    observations are put together by `merge_bitmaps`. Observations without an insight are under a null insight, so that whoever has no other counts.
    """
    at = F.col("participant_ord").cast("bigint")
    # the bit functions take a null for none, so a bucket of rows without an order has no bits
    return observations.groupBy(F.trim("insight").alias("insight"), F.floor(at / BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BITMAP))).alias("bits"))


def merge_bitmaps(maps: DataFrame, *by: str) -> DataFrame:
    """Bitmaps by fewer columns (`insight`, or none for everybody), or of several tables of them."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def people_in(maps: DataFrame, *by: str) -> DataFrame:
    """How many participants by `by`, those without an order as one."""
    n = F.when(F.col("bucket").isNull(), F.lit(1).cast("bigint")).otherwise(F.bitmap_count("bits"))
    return maps.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n"))


def byte_at(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def lowest(bits: Column) -> Column:
    """The place of the lowest bit that is set, null for none."""
    digits = F.hex(bits)
    zeros = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
    byte = byte_at(bits, F.floor(zeros / 2))
    return F.when(F.bitmap_count(bits) > 0, F.floor(zeros / 2) * 8 + F.bit_count(byte.bitwiseAND(-byte) - 1))


def first_orders(maps: DataFrame) -> DataFrame:
    """(insight, first_ord), from the lowest bit of an insight's lowest bucket; null if only participants without an order have it."""
    return maps.where("insight IS NOT NULL").groupBy("insight").agg(F.min(F.col("bucket") * BITMAP + lowest(F.col("bits"))).alias("first_ord"))


def marks_per_insight(maps: DataFrame) -> DataFrame:
    """(insight, first_ord, new, repeat, absent): the row sums of the grid, without its cells. Everybody without an order is one participant."""
    total = people_in(merge_bitmaps(maps)).select(F.col("n").alias("__all"))
    named = maps.where("insight IS NOT NULL")
    # one row, a number
    each = people_in(named, "insight").join(first_orders(maps), "insight").join(F.broadcast(total))
    return each.select("insight", "first_ord", F.lit(1).cast("bigint").alias("new"), (F.col("n") - 1).alias("repeat"), (F.col("__all") - F.col("n")).alias("absent"))


def cells(maps: DataFrame, lo: int, hi: int) -> DataFrame:
    """(insight, participant_ord, mark): the grid's cells for the participants of order lo to hi, and no others. Equals `matrix` there.

    An insight meets a bucket's participants by an equi-join on bucket and part, GRID_PARTS of them, as in `matrix`.
    """
    asked = range(lo // BITMAP, hi // BITMAP + 1)
    of = maps.where(F.col("bucket").between(asked.start, asked.stop - 1))
    places = F.filter(F.sequence(F.lit(0), F.lit(BITMAP - 1)), lambda p: F.call_function("shiftright", byte_at(F.col("bits"), F.floor(p / 8)), (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    part = F.pmod(F.xxhash64("insight"), F.lit(GRID_PARTS)).cast("int")
    within = lambda ps: F.filter(ps, lambda p: (F.col("bucket") * BITMAP + p).between(lo, hi))
    everybody = merge_bitmaps(of).select("bucket", within(places).alias("__people")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1))))
    every = first_orders(maps).withColumn("__part", part).withColumn("bucket", F.explode(F.sequence(F.lit(asked.start).cast("bigint"), F.lit(asked.stop - 1).cast("bigint"))))
    own = of.select(F.col("insight").alias("__i"), F.col("bucket").alias("__b"), "bits")
    grid = every.join(everybody, ["bucket", "__part"])
    grid = grid.join(own, (grid["insight"] == own["__i"]) & (grid["bucket"] == own["__b"]), "left").select("insight", "bucket", "first_ord", "bits", F.explode("__people").alias("p"))
    set_ = F.coalesce(F.call_function("shiftright", byte_at(F.col("bits"), F.floor(F.col("p") / 8)), (F.col("p") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    order = F.col("bucket") * BITMAP + F.col("p")
    mark = F.when(~set_, "ABSENT").when(order == F.col("first_ord"), "NEW").otherwise("REPEAT")
    return grid.select("insight", order.cast("bigint").alias("participant_ord"), mark.alias("mark"))
