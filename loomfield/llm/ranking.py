"""Gapless global positions without one task that sees all rows: range partitions, their counts, and a rank within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.llm.common import Workspace


def global_rank(work: Workspace, df: DataFrame, order: list[Column], name: str, position: str = "position", total: str = "total", weight: str | None = None) -> DataFrame:
    """df with `position` (0-based, by `order`; rows that tie in all of it are interchangeable) and `total` (rows). With a `weight`, a column, a row counts as so many.

    The range partitions are written once, so that a repeated task can't deal rows out anew. Only
    their counts, one row a partition, meet in a single task.
    """
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.save(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name)
    by_part = Window.orderBy("__part")
    count = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    counts = dealt.groupBy("__part").agg(F.sum(count).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(by_part) - F.col("__n")).alias("__before"), F.sum("__n").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total))
    upto = Window.partitionBy("__part").orderBy(*order)
    # rows before this one, or their weights
    inside = dealt.withColumn("__k", F.row_number().over(upto) - 1 if weight is None else F.sum(weight).over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
    # `before` has a row per range partition, a number fixed above
    return inside.join(F.broadcast(before), "__part").withColumn(position, F.col("__before") + F.col("__k")).drop("__part", "__before", "__k")
