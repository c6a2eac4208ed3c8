"""Named queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Rows of a task, about, where a row is small and its work is not.
TASK_ROWS = 1 << 13


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: registers the query by its function's name; sql is DuckDB SQL for the same rows."""

        def register(query: Query) -> Query:
            if query.__name__ in self.queries:
                raise ValueError(f"two queries are named {query.__name__}")
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df in tasks of about TASK_ROWS rows, for much work on small rows: tasks of a scan are cut by bytes, so they would be few and long."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)))
