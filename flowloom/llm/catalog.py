"""Collects the queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.session import prepare

# Texts travel to Python tasks in batches of bounded bytes.
BATCH_BYTES = str(8 << 20)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that these jobs are written for."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return prepare(spark)


def query(name: str, sql: str | None = None):
    """Register a query under `name`; `sql` only where SQL can state the result."""

    def add(run):
        QUERIES[name] = lambda spark, sf_dir: run(ready(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table in full."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
