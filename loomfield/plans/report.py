"""The nine relations of a workbook's quality report, from its cells before and after cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield import model
from loomfield.functions import text as T
from loomfield.operators import clean as C
from loomfield.operators import profile as P


def _values(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.coalesce("formula", "text"))


def cleaned_cells(cells: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned cells, header status per sheet, removed rows as workbook, sheet, row_idx, retained). Sheets without a confirmed header, and those with merges, pass unchanged."""
    by = C.sheet_key(cells)
    cell = [*by, "row_idx", "col_idx"]
    status = C.header_status(cells)
    risky = sheets.where("size(merges) > 0").select(*by)
    region = C.data_region(cells, status, risky)
    headers = cells.join(status.where("header_status = 'CONFIRMED'"), by).join(risky, by, "left_anti").where("row_idx = header_row and kind = 'TEXT'")
    heads = C.clean_headers(headers.select(*cell, "text")).select(*cell, F.col("clean").alias("__head"))
    tidy = C.clean_cells(region).select(*cell, F.col("text").alias("__tidy"), F.lit(True).alias("__in"))
    out = cells.join(heads, cell, "left").join(tidy, cell, "left")
    out = out.withColumn("text", F.when(F.col("__in"), F.col("__tidy")).otherwise(F.coalesce("__head", "text"))).drop("__head", "__tidy", "__in")
    data = out.join(region.select(*by, "row_idx").distinct(), [*by, "row_idx"], "left_semi")
    keys = C.cell_row_keys(data)
    gone = C.duplicates(keys, ["row_key"], "row_idx", tuple(by)).where("occurrence > 1").select(*by, "row_idx", "retained")
    return out.join(gone, [*by, "row_idx"], "left_anti"), status, gone


def report(cells: DataFrame, sheets: DataFrame) -> dict[str, DataFrame]:
    """Sheet name to frame; sheets go by workbook and name. Values of cells are never shown, only counts and places."""
    spark, by = cells.sparkSession, C.sheet_key(cells)
    after, status, gone = cleaned_cells(cells, sheets)
    risky = sheets.select(*by, (F.size("merges") > 0).alias("risky"), F.size("merges").alias("merged_ranges"))
    b, a = P.sheet_counts(cells), P.sheet_counts(after)
    changed = cells.select(*by, "row_idx", "col_idx", F.col("text").alias("b")).join(after.select(*by, "row_idx", "col_idx", F.col("text").alias("a")), [*by, "row_idx", "col_idx"]).where(C.changed(F.col("b"), F.col("a"))).join(status, by)
    n_changed = changed.groupBy(*by).agg(F.count(F.when(F.col("row_idx") == F.col("header_row"), 1)).alias("headers_normalized"), F.count(F.when(F.col("row_idx") > F.col("header_row"), 1)).alias("text_normalized"))
    n_gone = gone.groupBy(*by).agg(F.count("*").alias("duplicates_removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    statistics = (
        b.join(a.select(*by, F.col("populated").alias("populated_after")), by, "left").join(n_changed, by, "left").join(n_gone, by, "left").join(risky, by, "left").join(status.select(*by, "header_status"), by, "left")
        .select(*by, "n_rows", "n_cols", F.col("populated").alias("populated_before"), zero("populated_after"), zero("duplicates_removed"), zero("headers_normalized"), zero("text_normalized"), "formulas", zero("merged_ranges"), F.coalesce("header_status", F.lit("UNCERTAIN_HEADER")).alias("header_status"), F.when(F.col("risky"), "REVIEW").otherwise("CLEANED").alias("review_status"))
        .orderBy(*by)
    )
    region = _values(C.data_region(cells, status))
    tidy_region = _values(C.data_region(after, status))
    height = region.groupBy(*by).agg(F.count_distinct("row_idx").alias("n"))
    filled = lambda rows, name: rows.where("kind <> 'BLANK'").groupBy(*by, "col_idx").agg(F.count(F.when(~T.is_missing(F.col("value")) | F.col("num").isNotNull(), 1)).alias(name))
    height_after = tidy_region.groupBy(*by).agg(F.count_distinct("row_idx").alias("n_after"))
    missing = filled(region, "k").join(height, by).join(filled(tidy_region, "k_after"), [*by, "col_idx"], "left").join(height_after, by, "left")
    missing = missing.select(*by, "col_idx", "n", (F.col("n") - F.col("k")).alias("missing_before"), T.percent(F.col("n") - F.col("k"), F.col("n")).alias("pct_before"), (F.col("n_after") - F.coalesce("k_after", F.lit(0))).alias("missing_after"), T.percent(F.col("n_after") - F.coalesce("k_after", F.lit(0)), F.col("n_after")).alias("pct_after")).orderBy(*by, "col_idx")
    duplicate = b.select(*by).join(n_gone, by, "left").join(risky, by, "left").select(*by, zero("duplicates_removed").alias("removed"), F.lit("keep_first").alias("rule"), F.when(F.col("risky"), "merged_ranges").alias("skip_reason")).orderBy(*by)
    v = F.col("value")
    types = region.where("kind <> 'BLANK'").groupBy(*by, "col_idx").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count(F.when(T.date_like(v), 1)).alias("date_like"), F.count(F.when((F.col("kind") == "TEXT") & T.numeric_text(v), 1)).alias("numeric_text"), F.count(F.when(T.leading_zero(v), 1)).alias("leading_zeros"))
    types = types.withColumn("mixed", F.size("kinds") > 1).withColumn("action", F.lit("not_converted")).orderBy(*by, "col_idx")
    outliers = P.outliers(region.where("kind = 'NUMBER'"), [*by, "col_idx"], "num").orderBy(*by, "col_idx")
    merges = sheets.select(*by, F.explode("merges").alias("range"), F.lit("preserved").alias("status"))
    joins = no_joins(spark, by)
    counts = n_changed.select(F.lit(model.RULES[0]).alias("rule"), *by, F.col("headers_normalized").alias("n")).unionByName(n_changed.select(F.lit(model.RULES[1]).alias("rule"), *by, F.col("text_normalized").alias("n"))).unionByName(n_gone.select(F.lit(model.RULES[4]).alias("rule"), *by, F.col("duplicates_removed").alias("n")))
    actions = actions_with_zeros(model.rules(spark), counts.where("n > 0"))
    w = lambda code, severity, frame, where, text: frame.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), *by, where.alias("location"), F.lit(text).alias("message"), F.lit("review").alias("action"))
    column = F.concat(F.lit("column "), F.col("col_idx").cast("string"))
    none = F.lit(None).cast("string")
    warnings = [
        w("MERGED_CELLS_REVIEW", "medium", merges, F.col("range"), "merged range kept"),
        w("FORMULAS_PRESERVED", "info", b.where("formulas > 0"), none, "formulas kept as text"),
        w("IDENTIFIER_PRESERVED", "info", types.where("leading_zeros > 0"), column, "identifiers kept"),
        w("MIXED_TYPES_REVIEW", "medium", types.where("mixed"), column, "several kinds of values"),
        w("OUTLIERS_FLAGGED_NOT_MODIFIED", "low", outliers.where("flagged > 0"), column, "values beyond the fences"),
        w("MISSING_VALUES_NOT_IMPUTED", "low", missing.where("missing_before > 0"), column, "missing values"),
        w("UNCERTAIN_HEADER", "medium", status.where("header_status <> 'CONFIRMED'"), none, "no confirmed header"),
        w("NO_CROSS_SHEET_JOIN", "info", several_sheets(sheets, by), none, "sheets not joined: no key is agreed on"),
        w("UNSUPPORTED_FEATURE_REVIEW", "medium", sheets.where("size(merges) > 0"), none, "a sheet with merged ranges passes unchanged"),
    ]
    all_warnings = warnings[0]
    for x in warnings[1:]:
        all_warnings = all_warnings.unionByName(x)
    totals = statistics.agg(F.sum("populated_before").alias("populated_before"), F.sum("populated_after").alias("populated_after"), F.sum("duplicates_removed").alias("duplicates_removed"), F.sum("headers_normalized").alias("headers_normalized"), F.sum("text_normalized").alias("text_normalized"), F.count("*").alias("sheets"))
    summary = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in totals.columns))).alias("e")).select("e.*")
    frames = (summary, statistics, missing, duplicate, types, outliers, merges.unionByName(joins), actions, all_warnings.orderBy("code", *by, "location"))
    return dict(zip(model.REPORT_SHEETS, frames))


def no_joins(spark: SparkSession, by: list[str]) -> DataFrame:
    """The record that sheets are never joined, as no key is agreed on."""
    return spark.range(1).select(*(F.lit(None).cast("string").alias(c) for c in by), F.lit(None).cast("string").alias("range"), F.lit("join_analysis=not_applicable; reason=no_explicit_key_contract; joins_performed=0").alias("status"))


def several_sheets(sheets: DataFrame, by: list[str]) -> DataFrame:
    """Workbooks with more than one sheet; the sheet is null, as the finding is of the workbook."""
    books = [c for c in by if c != "sheet"]
    found = sheets.groupBy(*books).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(*(F.col(c) if c in books else F.lit(None).cast("string").alias(c) for c in by))


def actions_with_zeros(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Every rule in order, with its count per sheet or 0."""
    return rules.join(counts, "rule", "left").select("rule_ord", "rule", *C.sheet_key(counts), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy("rule_ord", *C.sheet_key(counts))


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code", *C.sheet_key(warnings)).agg(F.count("*").alias("n"))
