"""Connected components of an edge table by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import shared_dir

SCHEMA = "node bigint, other bigint"


def _minima(edges: DataFrame, name: str) -> DataFrame:
    """The smallest neighbour of each node; combined before the shuffle, so no node is hot."""
    return edges.groupBy("node").agg(F.min("other").alias(name))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches.

    `edges` has two bigint columns, `node` and `other`, in either direction and with
    repeats; loops and null ends are left out, so a node without other edges has no row.
    Every round halves distances at least, moves only edges between tables in the shared
    folder and joins with minima, whose skewed keys Spark splits; it ends when a round
    changes nothing.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark, "components")

    def stored(rows: DataFrame, number: int) -> DataFrame:
        rows.distinct().write.parquet(f"{folder}/{number}")
        return spark.read.schema(SCHEMA).parquet(f"{folder}/{number}")

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.select(F.count("*"), F.sum(F.xxhash64("node", "other") % 2**31)).first())

    # The larger end first.
    now = stored(
        edges.select("node", "other")
        .filter("node <> other")
        .select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")),
        0,
    )
    before, number = None, 0
    while (found := state(now)) != before:
        before, number = found, number + 1
        both = now.unionByName(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        # Large star: larger neighbours move to the smallest node around.
        large = (
            both.join(_minima(both, "least"), "node")
            .filter("other > node")
            .select(F.col("other").alias("node"), F.least("node", "least").alias("other"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = _minima(large, "least")
        small = (
            large.join(least, "node")
            .filter("other <> least")
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
            .unionByName(least.select("node", F.col("least").alias("other")))
        )
        now = stored(small, number)
    return now.select("node", F.col("other").alias("component"))
