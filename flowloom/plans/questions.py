"""Totals, traces, hitters and time-series points from stored snapshots.

Stored rows are cumulative, so totals first take the newest row of every flow and
only then add up. Filters and the as-of bound come before that aggregation and
reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.times import EPOCH, month_of, ntz
from flowloom.model import (
    FIVE_TUPLE,
    KEY_COLUMNS,
    KEY_TYPES,
    SPREAD,
    ExactTask,
    SketchTask,
    small_table,
)
from flowloom.operators.filters import as_of, filter_flow_keys, filter_flows, filter_hitters
from flowloom.operators.ranking import top_k
from flowloom.operators.snapshots import latest_per_flow, newest_values

Moment = datetime | str | Column

# Requests of one key that share a window, and tasks that are named in a filter.
REQUESTS_PER_WINDOW = 10_000
MOST_TASK_NAMES = 100

TASKS_SCHEMA = T.StructType(
    [T.StructField("task_name", T.StringType()), T.StructField("source", T.StringType())]
)
POINTS_SCHEMA = T.StructType(
    [T.StructField("position", T.IntegerType()), T.StructField("target", T.StringType())]
)


def aggregate_flows(
    flow_metrics: DataFrame,
    end: Moment | None = None,
    period_start: Moment | None = None,
    **filters,
) -> DataFrame:
    """Bytes, packets and number of flows per task, as of `end`.

    A flow that went quiet counts with its last row, even from an earlier period;
    `period_start` restricts the answer to one period.
    """
    rows = as_of(filter_flows(flow_metrics, **filters), end)
    if period_start is not None:
        began = ntz(period_start)
        # Snapshots of a period come after its start: months and times reach the scan.
        if "month" in rows.columns:
            rows = rows.where(F.col("month") >= month_of(began))
        rows = rows.where((F.col("snapshot_ts") > began) & (F.col("period_start") == began))
    return (
        latest_per_flow(rows, ("byte_count", "packet_count"))
        .groupBy("task_name")
        .agg(
            F.sum("byte_count").alias("total_bytes"),
            F.sum("packet_count").alias("total_packets"),
            F.count(F.lit(1)).alias("flow_count"),
        )
    )


def _life() -> list[Column]:
    """Lifecycle of the matching rows. With a partial key the totals are those of
    the largest single flow, not the sum."""
    return [
        F.min("start_time").alias("first_seen"),
        F.max("end_time").alias("last_seen"),
        F.max("packet_count").alias("total_packets"),
        F.max("byte_count").alias("total_bytes"),
    ]


def _or_defaults() -> list[Column]:
    """Epoch and 0 where nothing matched."""
    return [
        F.coalesce("first_seen", ntz(EPOCH)).alias("first_seen"),
        F.coalesce("last_seen", ntz(EPOCH)).alias("last_seen"),
        F.coalesce("total_packets", F.lit(0)).alias("total_packets"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
    ]


def trace_flow(
    flow_metrics: DataFrame, task: str, keys: Mapping[str, str], end: Moment | None = None
) -> DataFrame:
    """First and last time, packets and bytes of the flow with the given keys."""
    rows = flow_metrics.where(F.col("task_name") == task)
    return as_of(filter_flow_keys(rows, keys), end).agg(*_life()).select(*_or_defaults())


def _bit(field: str) -> int:
    return 1 << FIVE_TUPLE.index(field)


def _parsed_requests(requests: DataFrame) -> DataFrame:
    """Requests with `mask` (the fields they name) and `key` (mask and values)."""
    pairs = F.transform(
        F.split("flow_keys", ","),
        lambda pair: F.transform(F.split(pair, "=", 2), lambda side: F.trim(side)),
    )
    split = requests.withColumn("_pairs", pairs)
    malformed = F.exists(
        "_pairs",
        lambda pair: (F.size(pair) != 2) | ~F.get(pair, F.lit(0)).isin(*FIVE_TUPLE),
    )

    def text_of(field: str) -> Column:
        named = F.filter("_pairs", lambda pair: F.get(pair, F.lit(0)) == field)
        return F.get(F.try_element_at(named, F.lit(-1)), F.lit(1))

    complaint = F.concat(F.lit("invalid flow keys: "), F.coalesce("flow_keys", F.lit("NULL")))
    texts = split.select(
        "request_id",
        "task_name",
        "end_time",
        F.when(F.coalesce(malformed, F.lit(True)), F.raise_error(complaint))
        .otherwise(0)
        .alias("none"),
        *[text_of(field).alias(column) for field, column in KEY_COLUMNS.items()],
    )
    mask = F.col("none")
    for field, column in KEY_COLUMNS.items():
        mask = mask + F.when(F.col(column).isNotNull(), _bit(field)).otherwise(0)
    values = [F.col(column).cast(kind).alias(column) for column, kind in KEY_TYPES.items()]
    return texts.select(
        "request_id",
        "task_name",
        "end_time",
        mask.alias("mask"),
        F.struct(mask.alias("mask"), *values).alias("key"),
    )


def trace_requests(flow_metrics: DataFrame, requests: DataFrame) -> DataFrame:
    """Lifecycles for a table of (request_id, task_name, flow_keys, end_time).

    `flow_keys` is text such as 'SrcIP=1.2.3.4,DstPort=443'; a pair without '=' or
    an unknown name fails the job. Unmatched requests get epoch and 0.

    Each row takes part under the key combinations that the requests use (at most
    32), is kept only if some request names its key, and is reduced to one row per
    key and snapshot. Requests then read running values as of their end time, so
    no row is paired with every request of its task or key. The requests of a key that very
    many ask for are spread over several windows, each with a copy of that key's reduced
    history. Rows later than every request or of tasks that none names are not read.
    """
    every = _parsed_requests(requests)
    asked = every.groupBy("task_name", "key").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(REQUESTS_PER_WINDOW)).alias("windows")
    )
    share = F.pmod(F.xxhash64("request_id"), F.col("windows"))
    parsed = every.join(asked, ["task_name", "key"]).withColumn("share", share)
    # One row: key combinations in use, at most 2^5 small integers; a few of the tasks, to
    # tell whether they are few; and the last time that is asked for.
    masks, tasks, open_end, latest = every.agg(
        F.sort_array(F.collect_set("mask")),
        F.slice(F.sort_array(F.collect_set(F.col("task_name"))), 1, MOST_TASK_NAMES + 1),
        F.coalesce(F.bool_or(F.col("end_time").isNull()), F.lit(False)),
        F.max(F.col("end_time").cast("timestamp_ntz")),
    ).first()
    rows = flow_metrics
    if len(tasks) <= MOST_TASK_NAMES:
        rows = rows.where(F.col("task_name").isin(tasks))
    if latest is not None and not open_end:
        rows = as_of(rows, latest)

    seen = rows.select(
        "task_name",
        F.explode(F.array(*map(F.lit, masks or [0]))).alias("mask"),
        *KEY_TYPES,
        "snapshot_ts",
        "start_time",
        "end_time",
        "packet_count",
        "byte_count",
    ).select(
        "task_name",
        F.struct(
            "mask",
            *[
                F.when(F.col("mask").bitwiseAND(_bit(field)) != 0, F.col(column)).alias(column)
                for field, column in KEY_COLUMNS.items()
            ],
        ).alias("key"),
        "snapshot_ts",
        "start_time",
        "end_time",
        "packet_count",
        "byte_count",
    )
    history = (
        seen.join(asked, ["task_name", "key"], "left_semi")
        .groupBy("task_name", "key", F.col("snapshot_ts").alias("at"))
        .agg(*_life())
        .join(asked, ["task_name", "key"])
        .withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("windows") - 1)))
        .drop("windows")
        .withColumn("request_id", F.lit(None).cast("bigint"))
        .withColumn("is_request", F.lit(0))
    )
    unbounded = ntz("9999-12-31 00:00:00")
    probes = parsed.select(
        "task_name",
        "key",
        "share",
        F.coalesce(F.col("end_time").cast("timestamp_ntz"), unbounded).alias("at"),
        "request_id",
        F.lit(1).alias("is_request"),
    )
    so_far = (
        W.partitionBy("task_name", "key", "share")
        .orderBy("at", "is_request")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    answered = history.unionByName(probes, allowMissingColumns=True).select(
        "request_id",
        "is_request",
        F.min("first_seen").over(so_far).alias("first_seen"),
        F.max("last_seen").over(so_far).alias("last_seen"),
        F.max("total_packets").over(so_far).alias("total_packets"),
        F.max("total_bytes").over(so_far).alias("total_bytes"),
    )
    return answered.where(F.col("is_request") == 1).select("request_id", *_or_defaults())


def latest_hitters(
    heavy_hitters: DataFrame, task: str, hitter_type: int, limit: int, end: Moment | None = None
) -> DataFrame:
    """The `limit` largest newest values per flow, as of `end`."""
    rows = as_of(filter_hitters(heavy_hitters, task, hitter_type), end)
    newest = newest_values(rows, ["flow"], ["value"])
    return top_k(newest.select("flow", "value"), limit)


def latest_super_spreaders(
    heavy_hitters: DataFrame, task: str, limit: int, end: Moment | None = None
) -> DataFrame:
    """The `limit` largest newest spreads per flow, as of `end`."""
    return latest_hitters(heavy_hitters, task, SPREAD, limit, end)


def list_tasks(
    flow_metrics: DataFrame,
    heavy_hitters: DataFrame,
) -> DataFrame:
    """(task_name, source) of all stored tasks, exact before sketch."""
    exact = flow_metrics.select("task_name", F.lit("exact").alias("source"))
    sketch = heavy_hitters.select("task_name", F.lit("sketch").alias("source"))
    return exact.distinct().unionByName(sketch.distinct()).orderBy("source", "task_name")


def defined_tasks(
    spark: SparkSession, exact: Sequence[ExactTask], sketch: Sequence[SketchTask]
) -> DataFrame:
    """(task_name, source) of the defined tasks, exact before sketch; no table is read."""
    named = [(task.name, "exact") for task in exact] + [(task.name, "sketch") for task in sketch]
    return small_table(spark, named, TASKS_SCHEMA)


def timeseries_points(
    flow_metrics: DataFrame, targets: Iterable[str], end: Moment | None = None
) -> DataFrame:
    """(target, total_packets, end_ms): one point per target, 0 for unknown tasks.

    All targets are answered by one job. Without `end` the bound is a day from now.
    """
    wanted = list(targets)
    bound = ntz(end) if end is not None else ntz(F.current_timestamp() + F.expr("interval 1 day"))
    rows = flow_metrics.where(F.col("task_name").isin(wanted))
    totals = aggregate_flows(rows, bound).select(
        F.col("task_name").alias("target"), "total_packets"
    )
    points = small_table(flow_metrics.sparkSession, list(enumerate(wanted)), POINTS_SCHEMA)
    return (
        points.join(totals, "target", "left")
        .orderBy("position")
        .select(
            "target",
            F.coalesce("total_packets", F.lit(0)).alias("total_packets"),
            (F.unix_seconds(bound.cast("timestamp")) * 1000).alias("end_ms"),
        )
    )
