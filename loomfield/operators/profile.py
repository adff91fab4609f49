"""Quality profile of flat tables and cell relations; one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import text as T
from loomfield.operators.clean import sheet_key
from loomfield.operators.skew import same, spread_join
from loomfield.shared import new_folder

IQR_FENCE = 1.5
IQR_LEAST = 4
#: Of the sketch that brackets quantiles.
ACCURACY = 100_000
MANY_GROUPS = 20_000


def missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, missing, missing_pct, by one aggregation over all columns."""
    text = rows.select(*(F.col(c).cast("string").alias(c) for c in columns))
    one = text.agg(F.count("*").alias("n"), *(F.count(F.when(T.is_missing(F.col(c)), 1)).alias(f"m_{c}") for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing")) for c in columns)))
    return one.select("n", each.alias("e")).select("e.column", "n", "e.missing", T.percent(F.col("e.missing"), F.col("n")).alias("missing_pct"))


def kinds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, kind, n."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), T.kind_of(F.col(c).cast("string")).alias("kind")) for c in columns))).alias("e"))
    return long.groupBy("e.column", "e.kind").agg(F.count("*").alias("n"))


def mixed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_kinds, mixed: more than one kind besides blanks."""
    return kinds(rows, columns).where("kind <> 'BLANK'").groupBy("column").agg(F.count("*").alias("n_kinds")).withColumn("mixed", F.col("n_kinds") > 1)


def duplicate_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, distinct_rows, surplus."""
    n = rows.groupBy(T.row_key(*map(F.col, columns)).alias("k")).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows")).withColumn("surplus", F.col("rows") - F.col("distinct_rows"))


def quantiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """Per group: n, min, max and q, the exact quantiles (interpolated between ranks), null for none.

    A sketch brackets each quantile; what is below a bracket is counted, and only what is inside, about
    4 / ACCURACY of the rows, is ordered. So no task holds a group, and the work is two more scans. The
    brackets, a row a group, are fixed by writing them to the shared folder. They are broadcast up to MANY_GROUPS of them; more are joined by
    the group, and groups with very many rows are parted.
    """
    v = F.col(value).cast("double")
    ends = [min(1.0, max(0.0, p + e)) for p in at for e in (-2 / ACCURACY, 2 / ACCURACY)]
    base = [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max")]
    spark, keys = rows.sparkSession, [f"b{i}" for i in range(len(by))]
    sketch = rows.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys))).agg(*base, F.percentile_approx(v, F.array(*map(F.lit, ends)), ACCURACY).alias("ends"))
    folder = new_folder(spark, "brackets")
    sketch.write.parquet(f"{folder}/groups")
    groups = spark.read.schema(sketch.schema).parquet(f"{folder}/groups")
    key = F.struct(F.lit(0).alias("all"), *(F.col(k).alias(c) for c, k in zip(by, keys))).alias("by")
    brackets = groups.select(*keys, F.struct(key, "n", "min", "max", "ends").alias("g"))
    valued = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), v.alias("v")).where("v IS NOT NULL")
    if groups.count() <= MANY_GROUPS:
        named = brackets.withColumnsRenamed({k: f"k_{k}" for k in keys})
        inside = valued.join(F.broadcast(named), same(valued, named, keys, "k_"))
    else:
        inside = spread_join(valued, brackets, keys, ["v"])
    parts = [F.struct(F.sum((F.col("v") < lo).cast("bigint")).alias("below"), F.max(F.when(F.col("v") < lo, F.col("v"))).alias("prev"), F.min(F.when(F.col("v") > hi, F.col("v"))).alias("next")).alias(f"s{i}") for i in range(len(at)) for lo, hi in [(F.col("g.ends")[2 * i], F.col("g.ends")[2 * i + 1])]]
    around = inside.groupBy("g").agg(*parts).select("g", F.posexplode(F.array(*(f"s{i}" for i in range(len(at))))).alias("i", "s"))
    hit = F.array(*(F.when(F.col("v").between(F.col("g.ends")[2 * i], F.col("g.ends")[2 * i + 1]), i) for i in range(len(at))))
    values = inside.select("g", "v", F.explode(F.array_compact(hit)).alias("i")).groupBy("g", "i", "v").agg(F.count("*").alias("m"))
    upto = values.withColumn("upto", F.sum("m").over(Window.partitionBy("g", "i").orderBy("v")))
    ranked = upto.join(around, ["g", "i"])
    where = F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1) * (F.col("g.n") - 1)
    rank = lambda f: f(where).cast("bigint") - F.col("s.below")
    one = lambda f, name: F.min(F.when(F.col("upto") > rank(f), F.col("v"))).alias(name)
    chosen = ranked.groupBy("g", "i", "s").agg(one(F.floor, "lo"), one(F.ceil, "hi"), F.max("upto").alias("inside"))
    # a rank beside the bracket is its neighbour's
    value_at = lambda f, c: F.when(rank(f) < 0, F.col("s.prev")).when(rank(f) >= F.col("inside"), F.col("s.next")).otherwise(F.col(c))
    near = (rank(F.floor) >= -1) & (rank(F.ceil) <= F.col("inside"))
    share = where - F.floor(where)
    q = F.when(~near, F.raise_error(F.lit("a quantile is outside its bracket"))).otherwise((1 - share) * value_at(F.floor, "lo") + share * value_at(F.ceil, "hi"))
    done = chosen.select("g", F.struct("i", q.alias("q")).alias("x")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("q"))
    # groups without values have none
    left = brackets.join(done, "g", "left")
    return left.select(*(F.col(f"g.by.{c}").alias(c) for c in by), *(F.col(f"g.{c}").alias(c) for c in ("n", "min", "max")), "q")


def outliers(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, fences and flagged values per group; too few values give `insufficient_data`. Flags only. A null group is a group; NaN counts as missing."""
    kind = dict(rows.dtypes)[value]
    rows = rows.select(*by, (F.when(~F.isnan(value), F.col(value)) if kind in ("double", "float") else F.col(value)).alias(value))
    q = quantiles(rows, by, value, (0.25, 0.5, 0.75))
    q = q.select(*by, "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")
    q = q.withColumns({"lower": F.col("q1") - IQR_FENCE * (F.col("q3") - F.col("q1")), "upper": F.col("q3") + IQR_FENCE * (F.col("q3") - F.col("q1"))})
    fences = q.select(*(F.col(c).alias(f"__f_{c}") for c in by), "lower", "upper")
    # only what is outside goes on to be counted
    outside = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    flagged = rows.join(fences, same(rows, fences, by, "__f_")).where(outside).groupBy(*(F.col(c).alias(f"__g_{c}") for c in by)).agg(F.count("*").alias("flagged"))
    enough = F.col("n") >= IQR_LEAST
    joined = q.join(flagged, same(q, flagged, by, "__g_"), "left").drop(*(f"__g_{c}" for c in by))
    return joined.withColumn("flagged", F.when(enough, F.coalesce("flagged", F.lit(0)))).withColumn("state", F.when(enough, "flagged_not_modified").otherwise("insufficient_data"))


def describe(rows: DataFrame, value: str) -> DataFrame:
    c = F.col(value)
    moments = rows.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("stddev"))
    # one row meets one row
    return moments.join(quantiles(rows, [], value, (0.5,)).select(F.round(F.col("q")[0], 4).alias("median")))


def numeric_candidates(kind_counts: DataFrame, least: int = IQR_LEAST) -> DataFrame:
    return kind_counts.where((F.col("kind") == "NUMBER") & (F.col("n") >= least)).select("column")


def sheet_counts(cells: DataFrame) -> DataFrame:
    """Rows, columns, populated cells, formulas and merged cells of each sheet."""
    return cells.groupBy(*sheet_key(cells)).agg(F.max("row_idx").alias("n_rows"), F.max("col_idx").alias("n_cols"), F.count(F.when(F.col("kind") != "BLANK", 1)).alias("populated"), F.count(F.when(F.col("kind") == "FORMULA", 1)).alias("formulas"), F.count(F.when(F.col("in_merge"), 1)).alias("merged_cells"))


def before_after(rows: DataFrame, cleaned: DataFrame, columns: list[str], order: str = "row_idx") -> DataFrame:
    """Per column: cells changed, missing before and after; both tables have the same rows."""
    j = rows.select(order, *(F.col(c).alias(f"b_{c}") for c in columns)).join(cleaned.select(order, *(F.col(c).alias(f"a_{c}") for c in columns)), order)
    one = j.agg(*(F.count(F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), 1)).alias(f"ch_{c}") for c in columns), *(F.count(F.when(T.is_missing(F.col(f"b_{c}")), 1)).alias(f"mb_{c}") for c in columns), *(F.count(F.when(T.is_missing(F.col(f"a_{c}")), 1)).alias(f"ma_{c}") for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"ch_{c}").alias("changed"), F.col(f"mb_{c}").alias("missing_before"), F.col(f"ma_{c}").alias("missing_after")) for c in columns))).alias("e")).select("e.*")
