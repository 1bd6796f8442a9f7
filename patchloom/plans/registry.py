"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with the SQL that gives the same rows (None: rows only)."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df, *keys: str, rows: int | None = None):
    """``df`` dealt by ``keys`` to three tasks a core: rows that take long each come from files too small to be split.

    With ``rows`` to as many more tasks as leave each about that many: what a task's rows are cut into then stays bounded."""
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, -(-df.count() // rows)) if rows else tasks, *keys)
