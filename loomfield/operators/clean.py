"""Conservative cleaning: white space and exact duplicates only; nothing is imputed, converted, capped or dropped otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import text as T
from loomfield.operators.skew import carried, earlier, in_intervals, summaries


def clean_headers(headers: DataFrame) -> DataFrame:
    """headers(workbook where there are several, sheet, col_idx, text) with `clean`: normalised unless that would make it empty or not unique in its sheet; `status` tells which."""
    norm = T.header_name(F.col("text"))
    same = F.count("*").over(Window.partitionBy(*sheet_key(headers), "norm"))
    rows = headers.withColumn("norm", norm).withColumn("same", same)
    status = F.when(F.coalesce(F.col("norm"), F.lit("")) == "", "EMPTY").when(F.col("same") > 1, "DUPLICATE").when(F.col("norm") == F.col("text"), "SAME").otherwise("RENAMED")
    return rows.withColumn("status", status).withColumn("clean", F.when(F.col("status") == "RENAMED", F.col("norm")).otherwise(F.col("text"))).drop("norm", "same")


def sheet_key(rows: DataFrame) -> list[str]:
    """What tells sheets apart: the workbook, where the rows have it, and the name."""
    return [c for c in ("workbook", "sheet") if c in rows.columns]


def header_status(cells: DataFrame) -> DataFrame:
    """Per sheet: its first row with a value and whether that is a header (over half of it text, two cells or more, no blank inside the used width, names unique)."""
    filled = cells.where("kind <> 'BLANK'")
    by = sheet_key(cells)
    first = filled.groupBy(*by).agg(F.min("row_idx").alias("header_row"), F.min("col_idx").alias("lo"), F.max("col_idx").alias("hi"))
    row = filled.join(first, by).where("row_idx = header_row")
    s = row.groupBy(*by, "header_row", "lo", "hi").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "TEXT", 1)).alias("n_text"), F.count_distinct(T.header_name(F.col("text"))).alias("names"))
    good = (F.col("n_text") * 2 > F.col("n")) & (F.col("n") >= 2) & (F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("names") == F.col("n"))
    return s.select(*by, "header_row", F.when(good, "CONFIRMED").otherwise("UNCERTAIN_HEADER").alias("header_status"))


def data_region(cells: DataFrame, status: DataFrame, risky: DataFrame | None = None) -> DataFrame:
    """Cells below a confirmed header; sheets of `risky` are left out."""
    by = sheet_key(cells)
    rows = cells.join(status.where("header_status = 'CONFIRMED'"), by).where("row_idx > header_row").drop("header_status")
    return rows if risky is None else rows.join(risky.select(*by).distinct(), by, "left_anti")


def clean_cells(cells: DataFrame) -> DataFrame:
    """Text cells normalised, identifiers but for NBSP and formulas kept."""
    return cells.withColumn("text", F.when(F.col("kind") == "TEXT", T.clean_text(F.col("text"))).otherwise(F.col("text")))


def clean_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same for a flat table's text columns; formulas are cells that begin with =."""
    return rows.withColumns({c: F.when(T.is_formula(F.col(c)), F.col(c)).otherwise(T.clean_text(F.col(c))) for c in columns})


def keyed_rows(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """rows with row_key, a digest of 64 hexadecimal figures, so the shuffle carries no texts twice. Rows blank in all columns have a key each."""
    blank = F.lit(True)
    for c in columns:
        blank = blank & T.is_missing(F.col(c).cast("string"))
    return rows.withColumn("row_key", F.when(blank, F.concat(F.lit("blank-"), F.coalesce(F.col(order).cast("string"), F.lit("")))).otherwise(T.row_key(*map(F.col, columns))))


def duplicates(rows: DataFrame, columns: list[str], order: str = "row_idx", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with row_key, occurrence (1 for the first) and retained (the first one's order value). Rows blank in all columns are exempt and always 1.

    A row that very many others equal is numbered in intervals of `order`: within each, and on from the rows of the intervals before it.
    """
    key = [*by, "row_key"]
    cut, any_hot = in_intervals(keyed_rows(rows, columns, order), key, order)
    w = Window.partitionBy(*key, "__b").orderBy(order)
    numbered = cut.withColumn("occurrence", F.row_number().over(w)).withColumn("retained", F.first(order).over(w))
    if any_hot:
        whole = summaries(cut, key, F.count("*").alias("__n"), F.min(order).alias("__first"))
        first = F.min("__first").over(Window.partitionBy(*key)).alias("__retained")
        carry = whole.select(*key, "__b", F.coalesce(F.sum("__n").over(earlier(key)), F.lit(0)).alias("__before"), first)
        joined = carried(numbered, key, carry)
        numbered = joined.withColumn("occurrence", (F.col("occurrence") + F.coalesce("__before", F.lit(0))).cast("int")).withColumn("retained", F.coalesce("__retained", "retained")).drop("__before", "__retained")
    return numbered.drop("__b")


def keep_first(rows: DataFrame, columns: list[str], order: str = "row_idx", by: tuple[str, ...] = ()) -> DataFrame:
    """The first of equal rows, by a minimum that each task takes of its own rows before they are shuffled, so no key gathers its rows."""
    keyed = keyed_rows(rows, columns, order)
    return keyed.groupBy(*by, "row_key").agg(F.min_by(F.struct(*rows.columns), F.struct(order)).alias("__row")).select("__row.*")


def removed(rows: DataFrame, columns: list[str], order: str = "row_idx", by: tuple[str, ...] = ()) -> DataFrame:
    """Removed rows with the row that stands for them."""
    return duplicates(rows, columns, order, by).where("occurrence > 1").select(*by, order, "retained")


def clean(rows: DataFrame, columns: list[str], order: str = "row_idx") -> DataFrame:
    """White space first, then duplicates of the normalised values."""
    return keep_first(clean_table(rows, columns), columns, order)


def cell_row_keys(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row_idx, row_key) of sheet rows; kind is part of the key, blanks are not."""
    one = F.struct("col_idx", "kind", F.coalesce("formula", "text").alias("v"))
    return cells.where("kind <> 'BLANK'").groupBy(*sheet_key(cells), "row_idx").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256).alias("row_key"))


def changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)
