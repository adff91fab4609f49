"""Joins, sets and windows that the workflow artifacts need, beyond what Spark names directly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.operators.skew import carried, earlier, in_intervals, running_last, spread_join, summaries

#: Hash buckets by which tables are compared.
BUCKETS = 65_536
#: A cell of one level has 2**BITS cells of the level below.
BITS = 3


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row strictly before it: one shuffle by key, a union and a running last value. Hot keys are cut by time."""
    cols = [c for c in left.columns if c not in by and c != time]
    l = left.select(*by, time, F.struct(*cols).alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__r"), F.lit(0).alias("__side"))
    r = right.select(*by, time, F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(*values).alias("__r"), F.lit(1).alias("__side"))
    both = running_last(l.unionByName(r), by, [time, "__side"], F.col("__r"), "__last").where("__side = 0")
    return both.select(*by, time, "__l.*", *(F.col(f"__last.{v}").alias(f"last_{v}") for v in values))


def sessions(events: DataFrame, user: str, time: str, gap_seconds: int) -> DataFrame:
    """Per session: user, start, end, n; a pause longer than the gap begins a new one.

    A hot user's rows are cut into intervals of time. Sessions are made within each; of an
    interval, its first and last times and the start of its last session tell whether its first session goes on from
    the one before, and where that one began, so that parts of one session share a start and are added up.
    """
    cut, any_hot = in_intervals(events.select(user, time), [user], time)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    w = Window.partitionBy(user, "__b").orderBy(time)
    new = F.when(F.lag(time).over(w).isNull() | (micros(time) - micros("__p") > gap_seconds * 1_000_000), 1).otherwise(0)
    cut = cut.withColumn("__p", F.lag(time).over(w)).withColumn("__new", new).withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(user, "__b", "__s").agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count("*").alias("n"))
    if any_hot:
        whole = summaries(parts, [user], F.min("session_start").alias("lo"), F.max("session_end").alias("hi"), F.max("session_start").alias("__last"), F.count("*").alias("__n"))
        before = F.max("hi").over(earlier([user]))
        goes_on = F.coalesce(micros("lo") - micros("__hi") <= gap_seconds * 1_000_000, F.lit(False))
        ends = whole.withColumn("__hi", before).withColumn("__on", goes_on)
        # the session that is open at an interval's end began in it, unless all of it goes on
        began = F.when(~F.col("__on") | (F.col("__n") > 1), F.col("__last"))
        carry = ends.withColumn("__began", began).select(user, "__b", "__on", F.last("__began", ignorenulls=True).over(earlier([user])).alias("__from"))
        start = F.when(F.col("__on") & (F.col("__s") == 1), F.col("__from")).otherwise(F.col("session_start"))
        same_start = carried(parts, [user], carry).select(user, start.alias("session_start"), "session_end", "n")
        parts = same_start.groupBy(user, "session_start").agg(F.max("session_end").alias("session_end"), F.sum("n").alias("n"))
    return parts.select(user, "session_start", "session_end", "n")


def missing_artifacts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.join(actual, expected.columns, "left_anti")


def prints(rows: DataFrame) -> DataFrame:
    """(bucket, n, sum, xor): what the rows of each of BUCKETS hash buckets add up to, in whatever order they come. Each task adds up its own rows before anything is shuffled."""
    hashed = rows.select(F.xxhash64(*rows.columns).alias("h"), F.xxhash64(F.lit(1), *rows.columns).alias("g"))
    return hashed.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("g").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor"))


def differing(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in the buckets whose prints differ. Equal tables have none; a bucket with a different row is told by 128 bits.

    The list of buckets, BUCKETS numbers at most, goes to the rows, so that neither table is shuffled.
    """
    b = b.toDF(*a.columns)
    theirs = prints(b).withColumnsRenamed({c: f"b_{c}" for c in ("bucket", "n", "sum", "xor")})
    both = prints(a).join(theirs, F.col("bucket") == F.col("b_bucket"), "full_outer")
    unlike = ~(F.col("n").eqNullSafe(F.col("b_n")) & F.col("sum").eqNullSafe(F.col("b_sum")) & F.col("xor").eqNullSafe(F.col("b_xor")))
    found = F.broadcast(both.where(unlike).select(F.coalesce("bucket", "b_bucket").alias("__bucket")))
    of = lambda rows: rows.join(found, F.pmod(F.xxhash64(*rows.columns), F.lit(BUCKETS)) == F.col("__bucket"), "left_semi")
    return of(a), of(b)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with repetitions, and which: left or right. Columns go by place; only rows of differing buckets are compared and shuffled."""
    a, b = differing(a, b)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only either table has."""
    return set_difference(a, b).agg(F.count(F.when(F.col("side") == "left", 1)).alias("only_left"), F.count(F.when(F.col("side") == "right", 1)).alias("only_right"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def top_per_group(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """Rows of rank 1 to k; Spark limits each group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Points within [lo, hi] of a range, and equal in `by`, by equi-join on cells of `width` rather than by all pairs."""
    cell = lambda c: F.floor(F.col(c) / width).cast("bigint")
    spread = ranges.withColumn("__cell", F.explode(F.sequence(cell(lo), cell(hi))))
    return points.withColumn("__cell", cell(at)).join(spread, [*by, "__cell"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("__cell")


def covering(a: Column, b: Column, levels: Column) -> Column:
    """(level, cell) of the fewest aligned cells that together are the leaf cells a to b: short runs at both ends of each level, so some 2 * 2**BITS a level however long the range is."""
    bits = lambda k: (k * BITS).cast("int")
    up = lambda x, k: F.call_function("shiftright", x, bits(k))
    first = lambda k: -up(-a, k)
    last = lambda k: up(b + 1, k) - 1
    cells = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    def at(k: Column) -> Column:
        wide, lo, hi = k + 1, first(k), last(k)
        left, right = first(wide) * 2**BITS, (last(wide) + 1) * 2**BITS
        own = F.when(first(wide) > last(wide), cells(lo, hi)).otherwise(F.concat(cells(lo, left - 1), cells(right, hi)))
        return F.transform(own, lambda c: F.struct(k.alias("level"), c.alias("cell")))

    return F.flatten(F.transform(levels, at))


def points_within(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float, by: tuple[str, ...] = (), after_start: bool = False) -> DataFrame:
    """Points within [lo, hi] of a range (or (lo, hi], `after_start`), and equal in `by`, for ranges of any length.

    A range goes to the aligned cells that make it up, a point to its cell on each level, of which there are
    as many as the longest range needs, the logarithm of its length in `width`. A cell above the lowest level has
    matches only. Cells with many points are parted by skew's rule, and their ranges go to each part.
    """
    leaf = lambda c: F.floor(F.col(c) / width).cast("bigint")
    ranges = ranges.where(F.col(lo) <= F.col(hi)).dropna(subset=list(by)) if by else ranges.where(F.col(lo) <= F.col(hi))
    points = points.dropna(subset=[*by, at])
    longest = ranges.agg(F.max(leaf(hi) - leaf(lo) + 1)).first()[0] or 1
    levels = F.sequence(F.lit(0), F.lit((int(longest).bit_length() + BITS - 1) // BITS))
    spread = ranges.withColumn("__at", F.explode(covering(leaf(lo), leaf(hi), levels))).select("*", F.col("__at.level").alias("__level"), F.col("__at.cell").alias("__cell")).drop("__at")
    own = points.withColumn("__level", F.explode(levels)).withColumn("__cell", F.call_function("shiftright", leaf(at), F.col("__level") * BITS))
    joined = spread_join(own, spread, [*by, "__level", "__cell"], points.columns)
    start = F.col(at) > F.col(lo) if after_start else F.col(at) >= F.col(lo)
    return joined.where(start & (F.col(at) <= F.col(hi))).drop("__level", "__cell")


def overlap_join(left: DataFrame, right: DataFrame, span: tuple[str, str], other: tuple[str, str], width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a left and a right row, equal in `by`, whose ranges (`span` of the left, `other` of the right, numbers, ends included) share a point. `width` is about the length of a common range; it changes the time, not the result.

    Of two ranges that overlap, one begins within the other: the left in the right, or the right after the left's
    start within the left. Each pair comes once, from one of two joins of points with ranges. A range that ends before it begins, or
    with a null end, and a null in `by` match nothing. Equal rows match each by itself. Columns apart from `by` must have different names.
    """
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    left, right = left.where(F.col(span[0]) <= F.col(span[1])), right.where(F.col(other[0]) <= F.col(other[1]))
    names = [*left.columns, *(c for c in right.columns if c not in by)]
    inside = points_within(left, right, span[0], *other, width, by).select(names)
    return inside.unionByName(points_within(right, left, other[0], *span, width, by, after_start=True).select(names))


def preview(rows: DataFrame, order: list[str], n_rows: int = 32, n_cols: int = 4) -> DataFrame:
    """The first rows by `order`, and the first columns: for people to look at."""
    return rows.orderBy(*order).limit(n_rows).select(*rows.columns[:n_cols])


def top(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of all: each task keeps k, so no task sorts the table."""
    return rows.orderBy(*order).limit(k)


def with_retry(step, times: int = 2, codes: tuple[str, ...] = ("API_ERROR", "TIMEOUT")):  # noqa: ANN001, ANN201
    """Runs a step again on a passing error of the stated codes."""
    from loomfield.errors import EngineError

    for k in range(times):
        try:
            return step()
        except EngineError as e:
            if e.code not in codes or k + 1 == times:
                raise
    raise AssertionError
