"""Scorecards: nested groups of criteria with a score, an analysis and solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions import text as T

NESTED = "map<string,map<string,struct<score:string,analysis:string,solutions:array<string>>>>"
NO_SOLUTION = "No improvement needed."


def explode_scores(nested: DataFrame, column: str = "groups") -> DataFrame:
    """category, criterion, num, den, analysis, solutions; groups may have any number of criteria."""
    groups = nested.select(*(c for c in nested.columns if c != column), F.explode(column).alias("category", "criteria"))
    each = groups.select(*(c for c in groups.columns if c != "criteria"), F.explode("criteria").alias("criterion", "s"))
    return each.withColumns({"num": T.score_num(F.col("s.score")), "den": T.score_den(F.col("s.score")), "analysis": F.col("s.analysis"), "solutions": F.col("s.solutions")}).drop("s")


def rollup(scores: DataFrame, by: str = "category") -> DataFrame:
    """Points and mean of each group, and of all (category null, is_total 1)."""
    return scores.rollup(by).agg(F.sum("num").cast("bigint").alias("points"), F.sum("den").cast("bigint").alias("possible"), F.count("*").alias("criteria"), F.round(F.sum("num") / F.sum("den"), 6).alias("mean"), F.grouping(by).cast("int").alias("is_total"))


def with_solutions(scores: DataFrame) -> DataFrame:
    """Criteria that have a real solution."""
    return scores.where(F.exists("solutions", lambda x: F.trim(x) != NO_SOLUTION)).select("category", "criterion", F.size(F.filter("solutions", lambda x: F.trim(x) != NO_SOLUTION)).alias("n_solutions"))
