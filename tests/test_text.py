from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomfield.functions import text as T


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


CASES = [
    (T.header_name, " Full  Name ", "Full Name"), (T.header_name, "A B", "A B"), (T.clean_text, " x ", "x"), (T.clean_text, "a\r\nb", "a\nb"), (T.clean_text, "a  b", "a b"),
    (T.clean_text, "00123", "00123"), (T.clean_text, "12345678901234567890", "12345678901234567890"), (T.clean_text, "AB-12", "AB-12"), (T.clean_text, None, None), (T.clean_text, "N/A", "N/A"),
    (T.is_missing, "  ", True), (T.is_missing, None, True), (T.is_missing, "None", False), (T.kind_of, "007", "IDENTIFIER"), (T.kind_of, "7.5", "NUMBER"), (T.kind_of, "=A1", "FORMULA"), (T.kind_of, "2024-01-01", "DATE"), (T.kind_of, "x", "TEXT"), (T.kind_of, "", "BLANK"),
    (T.pipe_cells, "| a | b\\|c |  |", ["a", "b|c", ""]), (T.bullet_name, "- **k**: v", "k"), (T.bullet_text, "- **k**: v", "v"), (T.participant_of, "Insights — Ann Lee", "Ann Lee"),
    (T.mark_of, "🔵", "NEW"), (T.mark_of, "🌐", "REPEAT"), (T.mark_of, "⚪️", "ABSENT"), (T.mark_of, "⚪", "ABSENT"), (T.symbol_of, "NEW", "🔵"), (T.bare_label, "**🔵 New Insights**", "New Insights"),
    (T.score_num, "9/10", 9), (T.score_den, "9/10", 10), (T.score_num, "n/a", None), (T.fenced_block, "x\n```markdown\na\nb\n```\ny", "a\nb"), (T.fenced_block, " plain ", "plain"),
    (T.is_approval, " GỬI ", True), (T.is_approval, "no", False), (T.path_stem, "/a/b/Ann.v2.MP3", "Ann.v2"), (T.path_extension, "/a/b/x.XLSX", ".xlsx"), (T.slug, "Decision Making", "decision-making"),
    (T.seconds_of, "01:02:03", 3723), (T.seconds_of, "02:03", 123), (T.rating_of, "an 8 of 10", 8), (T.rating_of, "none", None), (T.column_number, "AA", 27), (T.is_optional, "Why? (optional)", True), (T.theme_colour, "4. Usage", "#FFD2B8"), (T.theme_colour, "x", None),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES)
def test_scalar(spark, f, value, want):
    assert one(spark, f, value) == want


def test_ranges_and_clock(spark):
    assert tuple(one(spark, T.range_corners, "A1:D32")) == (1, 1, 32, 4)
    assert tuple(one(spark, T.range_corners, "B7")) == (7, 2, 7, 2)
    assert one(spark, T.clock_of, 3723, "bigint") == "01:02:03"


def test_separator_is_dashes_only(spark):
    assert one(spark, lambda c: T.is_separator(T.pipe_cells(c)), "|---|:-:|") is True
    assert one(spark, lambda c: T.is_separator(T.pipe_cells(c)), "| - | a |") is False


def test_runs_of_any_table(spark):
    from loomfield.functions import table

    table.register(spark)
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, 1.5), ("b", 1, 1.5), (None, 7, 2.0), ("a", 4, 1.5), (None, 8, 3.0)]
    spark.createDataFrame(rows, "k string, o int, v double").createOrReplaceTempView("run_rows")
    got = spark.sql("SELECT * FROM runs_of(TABLE(run_rows) PARTITION BY k ORDER BY (o), 'v', 'o', 'k')")
    assert got.dtypes == [("k", "string"), ("value", "double"), ("first", "int"), ("last", "int"), ("n", "bigint")]
    assert {tuple(r) for r in got.collect()} == {("a", None, 1, 2, 2), ("a", 1.5, 3, 4, 2), ("b", 1.5, 1, 1, 1), (None, 2.0, 7, 7, 1), (None, 3.0, 8, 8, 1)}
    assert spark.sql("SELECT n FROM runs_of(TABLE(SELECT * FROM run_rows WHERE k = 'z') PARTITION BY k ORDER BY (o), 'v', 'o')").collect() == []
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM runs_of(TABLE(run_rows) PARTITION BY k ORDER BY (o), 'nothing', 'o')").collect()
