"""Registry of runnable queries: a Spark plan and, where SQL can state it, the matching oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of narrow tables that a task joins and groups at most, so that its memory does not grow with the table.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Tables:
    """Lazy access to the tables of one data folder."""

    spark: SparkSession
    folder: str

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table whose rows are dealt out by a key, ahead of heavy work on its texts: a small file is one partition."""
        return getattr(self, name).repartition(key)

    def tasks(self, *names: str) -> int:
        """Partitions for a join of tables on their key: Spark's own number, or more where a task would get too many rows."""
        most = max(getattr(self, name).count() for name in names)
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-most // TASK_ROWS))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` is the oracle statement with the same column names."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
