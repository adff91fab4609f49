"""Phase routing and the journey map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield import model
from loomfield.errors import EngineError
from loomfield.functions import text as T


def canonical(rows: DataFrame) -> DataFrame:
    """Renames known columns; any other column is a participant."""
    return rows.withColumnsRenamed({c: model.ALIASES[c] for c in rows.columns if c in model.ALIASES})


def wide_to_long(rows: DataFrame, ids: list[str], name: str = "participant", value: str = "answer") -> DataFrame:
    """A row per participant column, with its ordinal."""
    others = [c for c in rows.columns if c not in ids]
    ordinal = F.array_position(F.array(*map(F.lit, others)), F.col(name)).cast("int")
    return rows.unpivot(ids, others, name, value).withColumn("participant_ord", ordinal)


def route(rows: DataFrame, variants: DataFrame, theme: str = "theme") -> DataFrame:
    """Rows whose theme is a known variant after trimming and lower-casing, with phase and phase_ord. The lookup is broadcast by Spark if it is small enough for that."""
    if theme not in rows.columns:
        raise EngineError("MISSING_COLUMN", theme)
    return rows.join(variants, T.fold(F.col(theme)) == F.col("variant")).drop("variant")


def rejects(rows: DataFrame, variants: DataFrame, theme: str = "theme", reason: str = "UNKNOWN_THEME") -> DataFrame:
    return rows.join(variants, T.fold(F.col(theme)) == F.col("variant"), "left_anti").withColumn("reason", F.lit(reason))


def counts(routed: DataFrame, phases: DataFrame) -> DataFrame:
    """Rows per phase, empty phases kept, in phase order."""
    n = routed.groupBy("phase").agg(F.count("*").alias("n"))
    return phases.join(n, "phase", "left").select("phase_ord", "phase", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy("phase_ord")


def complete_grid(a: DataFrame, b: DataFrame, filled: DataFrame, on: list[str], value: str, default: Column) -> DataFrame:
    """Every pair of two lookups, with a value or its default. The grid is what is asked for; Spark broadcasts a side only below its own size limit."""
    return a.crossJoin(b).join(filled, on, "left").withColumn(value, F.coalesce(value, default))


def journey_map(interpretations: DataFrame, phases: DataFrame, dimensions: DataFrame) -> DataFrame:
    """One row per dimension, one column per phase; missing cells are empty."""
    grid = complete_grid(phases, dimensions, interpretations.select("phase", "dimension", "value"), ["phase", "dimension"], "value", F.lit(""))
    return grid.groupBy("dim_ord", "dimension").pivot("phase", list(model.PHASES)).agg(F.first("value")).orderBy("dim_ord")


def check_interpretations(interpretations: DataFrame, phases: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Findings: a phase without a dimension, an unknown name, an emotion that isn't 1 to 5."""
    grid = phases.crossJoin(dimensions).select("phase", "dimension")
    missing = grid.join(interpretations, ["phase", "dimension"], "left_anti").withColumn("finding", F.lit("missing"))
    unknown = interpretations.join(grid, ["phase", "dimension"], "left_anti").select("phase", "dimension").withColumn("finding", F.lit("unknown"))
    level = T.rating_of(F.col("value"))
    emotion = interpretations.where((F.col("dimension") == model.DIMENSIONS[4]) & ~F.coalesce(level.between(1, 5), F.lit(False))).select("phase", "dimension").withColumn("finding", F.lit("emotion out of range"))
    return missing.unionByName(unknown).unionByName(emotion)


def render(rows: DataFrame, by: list[str], order: str, columns: list[str], name: str = "body") -> DataFrame:
    """Pipe-table lines of each group joined in order. A group is a file's worth of rows."""
    line = T.pipe_line(*map(F.col, columns))
    lines = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("lines"))
    return lines.select(*by, F.array_join(F.transform("lines", lambda x: x["l"]), "\n").alias(name))
