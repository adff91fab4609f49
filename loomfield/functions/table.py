"""Table functions over partitioned relations, for SQL text. Rows of a partition come one by one in its order, so a task holds none of them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class RunsOf:
    """runs_of(TABLE(t) PARTITION BY k ORDER BY (o), 'value', 'o'): runs of rows with equal `value`: value, first and last `o`, and how many rows.

    The columns' types are those of the table, whatever it is; nulls equal nulls. k, where it is wanted, is a third name: it comes first then.
    """

    def __init__(self) -> None:
        self.run: list | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, value: AnalyzeArgument, order: AnalyzeArgument, key: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table: TABLE(...) PARTITION BY ... ORDER BY ...")
        kinds = {f.name: f.dataType for f in rows.dataType}
        for x in (value, order, *([key] if key else [])):
            if x.value not in kinds:
                raise ValueError(f"no column {x.value!r} among {sorted(kinds)}")
        keyed = [StructField(key.value, kinds[key.value])] if key else []
        return AnalyzeResult(StructType([*keyed, StructField("value", kinds[value.value]), StructField("first", kinds[order.value]), StructField("last", kinds[order.value]), StructField("n", LongType())]))

    def eval(self, row, value: str, order: str, key: str | None = None):  # noqa: ANN001, ANN201
        v, at, head = row[value], row[order], ([row[key]] if key else [])
        if self.run is not None and self.run[-4] == v:
            self.run[-2], self.run[-1] = at, self.run[-1] + 1
        else:
            if self.run is not None:
                yield tuple(self.run)
            self.run = [*head, v, at, at, 1]

    def terminate(self):  # noqa: ANN201
        if self.run is not None:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    spark.udtf.register("runs_of", udtf(RunsOf))
