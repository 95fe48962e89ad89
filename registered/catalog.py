"""Collects queries and their SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from flowloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def by_value() -> None:
    """Let the task code of this folder travel to executors, as the package's does."""
    import registered

    if registered.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(registered)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is left out where SQL cannot state the result."""

    def add(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            by_value()
            return run(prepare(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add
