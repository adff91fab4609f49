"""Markdown tables and sectioned documents, read by Spark's own text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import text as T


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """doc, line_no (from 1), line. A document is one row before it is split, which keeps its lines in order."""
    whole = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("doc"), T.line_endings(F.col("value")).alias("value"))
    return split_lines(whole)


def split_lines(docs: DataFrame, text: str = "value") -> DataFrame:
    return docs.select("doc", F.posexplode(F.split(text, "\n")).alias("i", "line")).select("doc", (F.col("i") + 1).alias("line_no"), "line")


def tables(numbered: DataFrame) -> DataFrame:
    """doc, section, table_idx, line_no, place (0 header, 1 separator, from 2 rows), cells, header (its table's), n_header: every line of every pipe table."""
    w = Window.partitionBy("doc").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pipe = F.trim("line").startswith("|")
    rows = numbered.withColumn("section", F.last(T.heading(F.col("line")), ignorenulls=True).over(upto)).withColumn("pipe", pipe)
    rows = rows.withColumn("begins", F.col("pipe") & ~F.coalesce(F.lag("pipe").over(w), F.lit(False)))
    rows = rows.withColumn("table_idx", F.sum(F.col("begins").cast("int")).over(upto)).where("pipe").withColumn("cells", T.pipe_cells(F.col("line")))
    t = Window.partitionBy("doc", "table_idx").orderBy("line_no")
    return rows.withColumn("place", F.row_number().over(t) - 1).withColumn("header", F.first("cells").over(t)).select("doc", "section", "table_idx", "line_no", "place", "cells", "header", F.size("header").alias("n_header"), "line")


def table_rows(found: DataFrame) -> DataFrame:
    """Data rows. A separator is a table's second line only, so a row of dashes further down is data."""
    return found.where(~((F.col("place") == 1) & T.is_separator(F.col("cells"))) & (F.col("place") > 0))


def malformed(found: DataFrame) -> DataFrame:
    """doc, line_no, raw, reason of rows with another number of cells than their header."""
    return table_rows(found).where("size(cells) <> n_header").select("doc", "line_no", F.col("line").alias("raw"), F.lit("MALFORMED_ROW").alias("reason"))


def as_table(found: DataFrame, header: list[str]) -> DataFrame:
    """Good rows as columns by place, named so, with doc, section and line_no."""
    good = table_rows(found).where("size(cells) = n_header")
    return good.select("doc", "section", "line_no", *(F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)))


def named_rows(found: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Good rows with doc, section, line_no and the columns given by their names in headers: each table's cells go by its own header, wherever it has a name; null where it has none."""
    good = table_rows(found).where("size(cells) = n_header")
    place = lambda names: F.array_max(F.array(*(F.array_position("header", n) for n in names)))  # noqa: E731  0 without
    return good.select("doc", "section", "line_no", *(F.when(place(names) > 0, F.get("cells", (place(names) - 1).cast("int"))).alias(c) for c, names in columns.items()))


def names_of(found: DataFrame) -> list[str]:
    """All names that headers have, in order of the tables; as many rows as there are different names come to the driver."""
    names = found.where("place = 0").select("doc", "table_idx", F.posexplode("cells").alias("i", "name")).groupBy("name").agg(F.min(F.struct("doc", "table_idx", "i")).alias("at"))
    return [r["name"] for r in names.orderBy("at").collect()]


def insight_observations(numbered: DataFrame) -> DataFrame:
    """doc, participant_ord, participant, insight_no, insight, quote of sections "Insights — name", participants in order of appearance in their document."""
    rows = table_rows(tables(numbered)).withColumn("participant", T.participant_of(F.col("section"))).where("participant IS NOT NULL and size(cells) = n_header")
    first = rows.groupBy("doc", "participant").agg(F.min("line_no").alias("first_line"))
    order = first.withColumn("participant_ord", F.row_number().over(Window.partitionBy("doc").orderBy("first_line")))
    return rows.join(order, ["doc", "participant"]).select("doc", "participant_ord", "participant", F.get("cells", F.lit(0)).try_cast("int").alias("insight_no"), F.get("cells", F.lit(1)).alias("insight"), F.get("cells", F.lit(2)).alias("quote"))


def summary_bullets(numbered: DataFrame) -> DataFrame:
    """doc, insight, summary of bullets "**name**: text"."""
    return numbered.select("doc", T.bullet_name(F.col("line")).alias("insight"), T.bullet_text(F.col("line")).alias("summary")).where("insight IS NOT NULL")
