"""Schemas and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Phases in order, dimensions in order, rules in order, report sheets, log keys.
PHASES = ("awareness", "consideration", "decision making", "usage", "advocacy")
DIMENSIONS = ("Stage Goal", "Stage Touchpoints", "Stage Actions", "Stage Pain Points", "Stage Emotion (1-5)", "Stage Opportunities & Metrics")
THEMES = ("0. Warm-up", "1. Awareness", "2. Consideration", "3. Decision Making", "4. Usage", "5. Advocacy")
RULES = (
    "HEADER_WHITESPACE_NORMALIZATION",
    "DATA_WHITESPACE_NORMALIZATION",
    "IDENTIFIER_PRESERVATION",
    "FORMULA_PRESERVATION",
    "EXACT_DUPLICATE_ROW_REMOVAL",
    "MISSING_VALUE_NO_IMPUTATION",
    "OUTLIER_FLAG_ONLY",
    "TYPE_CONVERSION_DISABLED",
    "NO_CROSS_SHEET_JOIN",
)
REPORT_SHEETS = ("Summary", "Sheet Statistics", "Missing Values", "Duplicate Rows", "Type Issues", "Outliers", "Merge Issues", "Cleaning Actions", "Warnings")
LOG_KEYS = ("schema_version", "status", "run", "input", "output", "packaged_replay_script", "workbook_inspection", "rules", "changes", "quality_findings", "validation", "warnings", "errors")
APPROVALS = ("ok", "yes", "gửi", "approved")
MARKS = {"NEW": "🔵", "REPEAT": "🌐", "ABSENT": "⚪️"}
#: Fill of each theme's cell.
THEME_COLOURS = {"0. Warm-up": "#E5E7EB", "1. Awareness": "#D9F0C2", "2. Consideration": "#CFE8F8", "3. Decision Making": "#FFE7A8", "4. Usage": "#FFD2B8", "5. Advocacy": "#E5D1F4"}
#: Names of columns in mapped transcripts and questionnaires, and ours for them.
ALIASES = {"#": "question_no", "STT": "question_no", "Theme": "theme", "Giai đoạn": "theme", "Question": "question", "Câu hỏi": "question", "Observed Variable": "targets", "Mục tiêu / Chủ đề khai thác": "targets", "Response": "response", "Topic": "topic"}

CELLS = "workbook string, sheet_idx int, sheet string, row_idx int, col_idx int, kind string, text string, num double, formula string, in_merge boolean"
SHEETS = "workbook string, sheet_idx int, sheet string, visibility string, n_rows int, n_cols int, merges array<string>"
WARNING = "code string, severity string, sheet string, location string, message string, action string"


def phases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(PHASES)], "phase_ord int, phase string")


def variants(spark: SparkSession, labels: tuple[str, ...] = PHASES) -> DataFrame:
    """variant, phase_ord, phase: "n. phase" and "phase" in lower case, and nothing else."""
    return spark.createDataFrame([(v, i + 1, p) for i, p in enumerate(labels) for v in (f"{i + 1}. {p}", p)], "variant string, phase_ord int, phase string")


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, d) for i, d in enumerate(DIMENSIONS)], "dim_ord int, dimension string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(RULES)], "rule_ord int, rule string")
