"""Orders and ranks of hitters. Equal values are ordered by flow text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def top_k(hitters: DataFrame, k: int) -> DataFrame:
    """The k largest values."""
    return hitters.orderBy(F.desc("value"), F.asc("flow")).limit(k)


def ranked(hitters: DataFrame, k: int) -> DataFrame:
    """The k largest values with a 1-based rank. Only the k rows meet in one task."""
    order = W.orderBy(F.desc("value"), F.asc("flow"))
    return top_k(hitters, k).withColumn("rank", F.row_number().over(order))


def sorted_hitters(hitters: DataFrame) -> DataFrame:
    """All hitters in descending order: a range-partitioned sort."""
    return hitters.orderBy(F.desc("value"), F.asc("flow"))
