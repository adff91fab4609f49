"""Event-time aggregates and first sightings on streams; batch frames work alike where Spark allows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def event_time(events: DataFrame, column: str = "ts", late: str = "1 day") -> DataFrame:
    """Casts to a zoned timestamp, which watermarks need, and sets the watermark; later rows are dropped by the state."""
    rows = events.withColumn(column, F.col(column).cast("timestamp"))
    return rows.withWatermark(column, late) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None, by: tuple[str, ...] = ("event_type",), column: str = "ts") -> DataFrame:
    """Counts and sums per window; with `slide`, windows overlap."""
    w = F.window(column, width, slide) if slide else F.window(column, width)
    return event_time(events, column).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *by, "n", "value")


def session_counts(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", column: str = "ts", late: str = "1 day") -> DataFrame:
    """Sessions end where nothing comes for the gap. On a stream, rows later than `late` are dropped in any output mode."""
    return event_time(events, column, late).groupBy(F.session_window(column, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], column: str = "ts") -> DataFrame:
    """One row per key: its first row by event time, of equal times the least. On a stream (update mode) a row that comes later but is earlier revises it.

    An aggregation by minimum, combined before the shuffle, so no key's rows meet in a task. Its state is one row a key, and it is kept: a key
    is known to be new only by it. A row without a time is a key's first only where it has no other.
    """
    others = [c for c in events.columns if c not in keys]
    whole = F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("at"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    first = events.groupBy(*keys).agg(F.min(whole).alias("__first"))
    return first.select(*keys, *(F.col(f"__first.c{i}").alias(c) for i, c in enumerate(others)))


def joined_within(left: DataFrame, right: DataFrame, by: list[str], at: tuple[str, str], within: str, late: str = "1 day") -> DataFrame:
    """Pairs of equal `by` whose right time is from the left time to `within` after it. On streams both sides have watermarks, and the condition tells Spark
    how long a row can still meet another, so state goes. Names of the sides but `by` must differ; times become zoned."""
    l = event_time(left, at[0], late)
    r = event_time(right.select(*(F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in right.columns)), at[1], late)
    same = [F.col(c) == F.col(f"__{c}") for c in by]
    return l.join(r, reduce(Column.__and__, same) & F.expr(f"`{at[1]}` >= `{at[0]}` AND `{at[1]}` <= `{at[0]}` + INTERVAL {within}")).drop(*(f"__{c}" for c in by))


def finished(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """What a stream gives of all that there is to read: it runs to its end, and its output is read back.

    Append: all rows. Complete: the last batch's. Update: the rows of all batches, with `batch`, as later ones revise earlier ones. The
    output and the checkpoint lie in `folder`, one every executor sees; a repeated batch overwrites its own part.
    """

    def sink(frame: DataFrame, k: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else k}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(sink).start()
    query.awaitTermination()
    spark, schema = stream.sparkSession, stream.schema
    rows = spark.read.schema(StructType([*schema, StructField("batch", LongType())]) if mode == "update" else schema).parquet(f"{folder}/out")
    return rows if mode == "update" else rows.select(*stream.columns)


def ingest(stream: DataFrame, sink, checkpoint: str):  # noqa: ANN001, ANN201
    """Runs what there is to read through sink(frame, batch id), then stops; a restart goes on from the checkpoint."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
