"""Tables by name, and a view with the defects that the clean test tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Formats by the end of a path's name.
FORMATS = {"parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "avro": "avro", "txt": "text"}


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A table by Spark's own sources; the kind goes by the path's end where it isn't given. CSV has a header, and tabs where it ends so. JDBC and others: kind and options as Spark names them."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    kind = kind or FORMATS.get(end, "parquet")
    given = ({"header": "true", "sep": "\t" if end == "tsv" else ",", "multiLine": "true", "escape": '"'} if kind == "csv" else {}) | options
    reader = spark.read.format(kind).options(**given)
    reader = reader if schema is None else reader.schema(schema)
    return reader.load() if kind == "jdbc" else reader.load(path)


def write(rows: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", by: tuple[str, ...] = (), **options: str) -> None:
    """The same formats as `read`."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    kind = kind or FORMATS.get(end, "parquet")
    given = ({"header": "true", "sep": "\t" if end == "tsv" else ",", "escape": '"'} if kind == "csv" else {}) | options
    rows.write.format(kind).options(**given).mode(mode).partitionBy(*by).save(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Expressions that Spark and DuckDB read alike.
DIRTY_COLUMNS = (
    "c_custkey AS row_idx",
    "c_custkey",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' || c_mktsegment || '  ' WHEN c_custkey % 5 = 0 THEN c_mktsegment || chr(160) || 'x  y' WHEN c_custkey % 3 = 0 THEN c_mktsegment || chr(13) || chr(10) || 'z' ELSE c_mktsegment END AS segment",
    "lpad(CAST(c_custkey AS STRING), 8, '0') AS ident",
    "CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS STRING) WHEN c_custkey % 4 = 1 THEN '2024-01-0' || CAST(c_custkey % 9 + 1 AS STRING) WHEN c_custkey % 4 = 2 THEN c_mktsegment ELSE NULL END AS mixed",
    "CASE WHEN c_custkey % 17 = 0 THEN '=A1+B1' ELSE c_name END AS name",
)
DIRTY_SQL = f"""
dirty AS (
  SELECT {', '.join(DIRTY_COLUMNS)} FROM customer
  UNION ALL
  SELECT row_idx + 10000000, c_custkey, segment, ident, mixed, name FROM (SELECT {', '.join(DIRTY_COLUMNS)} FROM customer) WHERE c_custkey % 13 = 0)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with padded, broken and missing cells, identifiers, formulas, and later copies of some rows."""
    rows = load(spark, sf_dir, "customer").selectExpr(*DIRTY_COLUMNS)
    copies = rows.where("c_custkey % 13 = 0").withColumn("row_idx", rows.row_idx + 10000000)
    return rows.unionByName(copies)
