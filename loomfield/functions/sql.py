"""Functions for use in SQL text: the library's expressions under names, as functions of the session that Spark inlines.

They are SQL expressions, so nothing leaves the JVM. `targets_of` is a table function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomfield.model import MARKS

MARK_CASES = " ".join(f"WHEN '{symbol}' THEN '{name}'" for name, symbol in MARKS.items())
FUNCTIONS = {
    "slug_of(s STRING) RETURNS STRING": "RETURN regexp_replace(lower(s), '\\\\s+', '-')",
    "seconds_of(clock STRING) RETURNS BIGINT": "RETURN aggregate(transform(split(clock, ':'), x -> CAST(x AS BIGINT)), 0L, (a, x) -> a * 60 + x)",
    "mark_of(symbol STRING) RETURNS STRING": f"RETURN CASE symbol {MARK_CASES} WHEN '⚪' THEN 'ABSENT' END",
    "score_of(s STRING) RETURNS DOUBLE": "RETURN try_divide(try_cast(split_part(s, '/', 1) AS DOUBLE), try_cast(split_part(s, '/', 2) AS DOUBLE))",
    "targets_of(cell STRING) RETURNS TABLE(target_no INT, target STRING)": "RETURN SELECT pos, col FROM posexplode(split(cell, '\\n'))",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them in the session and returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]
