"""Threshold comparison with an operator held in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check(value: Column, operator: Column, threshold: Column) -> Column:
    """Whether value compares with threshold; false for an unknown operator."""
    return F.coalesce(
        F.when(operator == ">", value > threshold)
        .when(operator == "<", value < threshold)
        .when(operator == "=", value == threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<=", value <= threshold),
        F.lit(False),
    )
