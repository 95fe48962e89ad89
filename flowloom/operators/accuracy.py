"""How close estimates are to the truth, and how evenly a key hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.hashing import seeded_bucket


def hitters_vs_truth(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """(flow, estimate, actual); estimate or actual is NULL on the unmatched side."""
    estimates = detected.select("flow", F.col("value").alias("estimate"))
    actuals = truth.select("flow", F.col("value").alias("actual"))
    return estimates.join(actuals, "flow", "full_outer")


def _relative_error(estimate: Column, actual: Column) -> Column:
    return F.abs(estimate - actual) / actual


def sketch_accuracy(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: hits and misses, mean relative error of hits, precision, recall, F1.

    A measure without cases is 0.
    """
    pairs = hitters_vs_truth(detected, truth)
    both = F.col("estimate").isNotNull() & F.col("actual").isNotNull()
    counts = pairs.agg(
        F.count_if(both).alias("tp"),
        F.count_if(F.col("actual").isNull()).alias("fp"),
        F.count_if(F.col("estimate").isNull()).alias("fn"),
        F.avg(F.when(both, _relative_error(F.col("estimate"), F.col("actual")))).alias("mean"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rates = counts.select(
        "tp",
        "fp",
        "fn",
        F.coalesce("mean", F.lit(0.0)).alias("mean_relative_error"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    )
    precision, recall = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", ratio(precision * recall * 2, precision + recall))


def flow_error_report(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """(flow, actual, estimate, relative_error) of every true flow; unseen flows estimate 0."""
    actuals = truth.select("flow", F.col("value").alias("actual"))
    found = estimates.select("flow", F.col("value").alias("estimate"))
    filled = actuals.join(found, "flow", "left").select(
        "flow", "actual", F.coalesce("estimate", F.lit(0)).alias("estimate")
    )
    error = F.when(
        F.col("actual") != 0, _relative_error(F.col("estimate"), F.col("actual"))
    ).otherwise(F.lit(0.0))
    return filled.withColumn("relative_error", error)


def mean_flow_error(report: DataFrame) -> DataFrame:
    """Mean relative error over all true flows."""
    return report.agg(
        F.count(F.lit(1)).alias("flows"), F.avg("relative_error").alias("mean_relative_error")
    )


def bucket_skew(rows: DataFrame, key: str, buckets: int, method: str = "xxhash64") -> DataFrame:
    """Load of hash buckets under a key column: mean, variance and variance / mean.

    Sums of loads and of their squares are integers, so the order of rows changes no digit.
    """
    bucket = seeded_bucket(F.lit(0), F.col(key).cast("string"), buckets, method)
    loads = rows.groupBy(bucket.cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("load"))
    every = rows.sparkSession.range(buckets).join(loads, "id", "left")
    load = F.coalesce("load", F.lit(0))
    sums = every.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(load).alias("total"),
        F.sum((load * load).cast("decimal(38,0)")).alias("squares"),
    )
    # n * sum(x^2) - sum(x)^2, exact: n^2 times the variance.
    total = F.col("total").cast("decimal(19,0)")
    scatter = (F.col("n") * F.col("squares") - total * total).cast("double")
    return sums.select(
        F.try_divide("total", "n").alias("mean_load"),
        F.try_divide(scatter, F.col("n") * F.col("n")).alias("variance"),
        F.try_divide(scatter, (F.col("n") * F.col("total"))).alias("variance_to_mean"),
    )
