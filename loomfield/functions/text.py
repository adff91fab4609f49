"""Scalar functions on columns; all of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.model import APPROVALS, MARKS, THEME_COLOURS

NBSP = "\u00a0"
BLANK = "[ \\t\\r\\n]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def nbsp_to_space(c: Column) -> Column:
    return F.translate(c, NBSP, " ")


def collapse(c: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(c, f"{BLANK}+", " ")


def trim_ends(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def line_endings(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def header_name(c: Column) -> Column:
    """NBSP, then inner runs, then the ends; case stays."""
    return trim_ends(collapse(nbsp_to_space(c)))


def fold(c: Column) -> Column:
    """For matching only."""
    return F.lower(F.trim(c))


def leading_zero(c: Column) -> Column:
    return c.rlike("^0[0-9]+$")


def long_digits(c: Column) -> Column:
    return c.rlike("^[0-9]{10,}$")


def letters_and_digits(c: Column) -> Column:
    return c.rlike("[A-Za-z]") & c.rlike("[0-9]") & ~c.rlike("\\s")


def date_like(c: Column) -> Column:
    return c.rlike("^\\d{4}-\\d{2}-\\d{2}") | c.rlike("^\\d{1,2}/\\d{1,2}/\\d{2,4}$")


def numeric_text(c: Column) -> Column:
    """Reads like a number; never converted."""
    return c.rlike("^[+-]?[0-9]+(\\.[0-9]+)?$")


def is_identifier(c: Column) -> Column:
    return leading_zero(c) | long_digits(c) | letters_and_digits(c) | date_like(c)


def clean_text(c: Column) -> Column:
    """Data cells: NBSP, line endings and ends; repeated spaces too unless the value is an identifier, of which only NBSP change."""
    plain = nbsp_to_space(c)
    return F.when(is_identifier(c), plain).otherwise(collapse_spaces(trim_ends(line_endings(plain))))


def is_missing(c: Column) -> Column:
    """Null, empty, or white space only."""
    return c.isNull() | (trim_ends(nbsp_to_space(c)) == "")


def is_formula(c: Column) -> Column:
    return c.startswith("=")


def kind_of(c: Column) -> Column:
    """Kind of a plain text cell: BLANK, FORMULA, IDENTIFIER, DATE, NUMBER or TEXT."""
    return F.when(is_missing(c), "BLANK").when(is_formula(c), "FORMULA").when(leading_zero(c) | long_digits(c), "IDENTIFIER").when(date_like(c), "DATE").when(numeric_text(c), "NUMBER").otherwise("TEXT")


def row_key(*columns: Column) -> Column:
    """Digest of a row's values; null and empty differ, and so do a number and its text if their kinds are given."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe-table line, trimmed; an escaped pipe stays in its cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))


def is_separator(cells: Column) -> Column:
    return (F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike("^:?-+:?$"))


def pipe_line(*columns: Column) -> Column:
    """A pipe-table line; pipes inside cells are escaped, nulls are empty."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns)), F.lit(" |"))


def bullet_name(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^- \*\*(.+?)\*\*: (.*)$", 1), F.lit(""))


def bullet_text(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^- \*\*(.+?)\*\*: (.*)$", 2), F.lit(""))


def heading(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^#+ (.*)$", 1), F.lit(""))


def participant_of(title: Column) -> Column:
    """The name after the em dash of an insights heading."""
    return F.nullif(F.regexp_extract(title, "^Insights — (.+)$", 1), F.lit(""))


def mark_of(c: Column) -> Column:
    """Symbol to NEW, REPEAT or ABSENT; variation selectors are ignored."""
    bare = F.translate(F.trim(c), "\ufe0f", "")
    return reduce(lambda w, kv: w.when(bare == kv[1].replace("\ufe0f", ""), kv[0]), MARKS.items(), F.when(F.lit(False), ""))


def symbol_of(c: Column) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), MARKS.items(), F.when(F.lit(False), ""))


def bare_label(c: Column) -> Column:
    """Without bold marks and symbols."""
    return F.trim(F.regexp_replace(c, "[\\*\U0001f535\U0001f310\u26aa\ufe0f]", ""))


def score_num(c: Column) -> Column:
    return F.get(F.split(c, "/"), F.lit(0)).try_cast("int")


def score_den(c: Column) -> Column:
    return F.get(F.split(c, "/"), F.lit(1)).try_cast("int")


def fenced_block(c: Column) -> Column:
    """The first fenced markdown block, or else the whole text trimmed."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "(?s)```markdown\\n(.*?)\\n```", 1), F.lit("")), F.trim(c))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def is_approval(c: Column) -> Column:
    return fold(c).isin(*APPROVALS)


def path_stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)


def path_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "\\s+", "-")


def values_of(c: Column) -> Column:
    """Values of a multi-line cell."""
    return F.split(c, "\n")


def percent(part: Column, total: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(total, F.lit(0)), 4)


def seconds_of(c: Column) -> Column:
    """HH:MM:SS or MM:SS to seconds."""
    return F.aggregate(F.transform(F.split(c, ":"), lambda x: x.try_cast("int")), F.lit(0), lambda a, x: a * 60 + x)


def clock_of(c: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(c / 3600).cast("int"), F.floor(c % 3600 / 60).cast("int"), (c % 60).cast("int"))


def rating_of(c: Column) -> Column:
    """The first whole number of an answer."""
    return F.regexp_extract(c, "(\\d+)", 1).try_cast("int")


def column_number(letters: Column) -> Column:
    """A to 1, Z to 26, AA to 27."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)


def range_corners(c: Column) -> Column:
    """Struct r1, c1, r2, c2 of an address like A1:D32; one cell is its own corner."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^([A-Za-z]+)(\d+)(?::([A-Za-z]+)(\d+))?$", k), F.lit(""))
    return F.struct(part(2).cast("int").alias("r1"), column_number(part(1)).alias("c1"), F.coalesce(part(4), part(2)).cast("int").alias("r2"), column_number(F.coalesce(part(3), part(1))).alias("c2"))


def is_optional(question: Column) -> Column:
    return F.contains(question, F.lit("(optional)"))


def theme_colour(theme: Column) -> Column:
    """Null for a theme that isn't listed."""
    return F.create_map(*(F.lit(x) for kv in THEME_COLOURS.items() for x in kv))[theme]
