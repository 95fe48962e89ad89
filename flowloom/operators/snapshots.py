"""Periodic cumulative snapshots and the latest row per flow.

Periods and intervals are event-time grids over one origin. A snapshot at time T
covers the packets of its period with ts < T; totals restart with each period,
and the end of a period always has a snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.keys import flow_key, flow_label
from flowloom.functions.times import EPOCH, grid, ntz
from flowloom.model import (
    COUNT,
    FLOW_METRICS_SCHEMA,
    KEY_TYPES,
    SIZE,
    SPREAD,
    VOTE_SKETCH,
    ExactTask,
    SketchTask,
)
from flowloom.operators.flows import multi_task_aggregate


def with_snapshot_times(
    rows: DataFrame,
    ts: str,
    interval: timedelta,
    period: timedelta,
    origin: datetime = EPOCH,
) -> DataFrame:
    """Rows with the period they fall in and the first snapshot that covers them."""
    carried = [name for name in rows.columns if name not in ("period_start", "snapshot_ts")]
    tick = rows.select("*", grid(ts, interval, origin).alias("_tick"))
    placed = tick.select("*", grid(ts, period, origin).alias("_period"))
    return placed.select(
        *carried,
        F.col("_period.start").alias("period_start"),
        F.least("_tick.end", "_period.end").alias("snapshot_ts"),
    )


def cumulative_snapshots(
    packets: DataFrame,
    tasks: ExactTask | Sequence[ExactTask],
    interval: timedelta,
    period: timedelta,
    origin: datetime = EPOCH,
    dense: bool = False,
    until: datetime | str | Column | None = None,
) -> DataFrame:
    """Running totals per flow at each snapshot, as flow_metrics rows.

    Sparse by default: a flow has a row only at snapshots where it changed, which
    gives the same latest row as of any time. `dense` repeats every live flow at
    every snapshot of its period up to `until` (default: the last snapshot taken).

    All tasks share one scan. Packets are reduced to one row per flow and snapshot
    before the running sum, so a window partition is bounded by the snapshots of one
    period, however many packets its flow has.
    """
    tasks = [tasks] if isinstance(tasks, ExactTask) else list(tasks)
    timed = with_snapshot_times(packets, "ts", interval, period, origin)
    ticks = multi_task_aggregate(timed, tasks, by=["period_start", "snapshot_ts"])
    following = F.lead("snapshot_ts").over(_by_snapshot()).alias("_next")
    running = running_totals(ticks, *([following] if dense else []))
    if dense:
        running = _repeat_until_next(running, packets, interval, period, origin, until)
    return running.select(*FLOW_METRICS_SCHEMA.names)


def _by_snapshot():
    """The rows of one flow and period in the order of their snapshots."""
    return W.partitionBy(*KEY_TYPES, "task_name", "period_start").orderBy("snapshot_ts")


def running_totals(ticks: DataFrame, *more: Column) -> DataFrame:
    """Cumulative snapshots from the totals of flows in each interval (flow_metrics rows).

    A window partition is bounded by the intervals of one period.
    """
    so_far = _by_snapshot().rowsBetween(W.unboundedPreceding, W.currentRow)
    return ticks.select(
        "snapshot_ts",
        "task_name",
        *KEY_TYPES,
        F.min("start_time").over(so_far).alias("start_time"),
        F.max("end_time").over(so_far).alias("end_time"),
        F.sum("byte_count").over(so_far).alias("byte_count"),
        F.sum("packet_count").over(so_far).alias("packet_count"),
        "period_start",
        *more,
    )


def hitters_at_snapshots(
    snapshots: DataFrame,
    task_name: str,
    flow_fields: Sequence[str],
    count_threshold: int,
    size_threshold: int,
) -> DataFrame:
    """heavy_hitters rows: flows of cumulative snapshots that reach a task's thresholds."""
    measures = F.explode(
        F.array(
            F.struct(F.lit(COUNT).alias("type"), F.col("packet_count").alias("value")),
            F.struct(F.lit(SIZE).alias("type"), F.col("byte_count").alias("value")),
        )
    )
    reached = F.when(F.col("type") == SIZE, size_threshold).otherwise(count_threshold)
    return (
        snapshots.select(
            "snapshot_ts",
            F.lit(task_name).alias("task_name"),
            flow_label(flow_fields).alias("flow"),
            measures.alias("measure"),
        )
        .select("snapshot_ts", "task_name", "flow", "measure.value", "measure.type")
        .where(F.col("value") >= reached)
    )


def spreads_at_snapshots(sketches: DataFrame, threshold: int) -> DataFrame:
    """heavy_hitters rows from spread sketches of flows and intervals.

    Sketches have (task_name, flow, period_start, snapshot_ts, sketch), and may have several
    versions of an interval: their union is that of the largest. The running union over a
    period, bounded by its intervals, is estimated at each snapshot.
    """
    interval = sketches.groupBy("task_name", "flow", "period_start", "snapshot_ts").agg(
        F.hll_union_agg("sketch").alias("sketch")
    )
    flow = W.partitionBy("task_name", "flow", "period_start").orderBy("snapshot_ts")
    so_far = flow.rowsBetween(W.unboundedPreceding, W.currentRow)
    union = F.hll_union_agg("sketch").over(so_far)
    return interval.select(
        "snapshot_ts",
        "task_name",
        "flow",
        F.hll_sketch_estimate(union).alias("value"),
        F.lit(SPREAD).alias("type"),
    ).where(F.col("value") >= threshold)


def sketch_snapshots(
    packets: DataFrame,
    tasks: SketchTask | Sequence[SketchTask],
    interval: timedelta,
    period: timedelta,
    origin: datetime = EPOCH,
) -> DataFrame:
    """heavy_hitters rows of sketch tasks at each snapshot, cumulative per period.

    Totals of vote tasks are exact: they are combined before the shuffle, which costs less
    than a sketch of the packets, and so their hitters have no error. Spread tasks keep one
    HyperLogLog sketch per flow and interval and report the running union, off by about
    1.04 / sqrt(m) of the spread. Periods restart both.
    """
    tasks = [tasks] if isinstance(tasks, SketchTask) else list(tasks)
    votes = [task for task in tasks if task.kind == VOTE_SKETCH]
    rows = []
    if votes:
        exact = [ExactTask(task.name, task.flow_fields) for task in votes]
        snapshots = cumulative_snapshots(packets, exact, interval, period, origin)
        rows += [
            hitters_at_snapshots(
                snapshots.where(F.col("task_name") == task.name), task.name, task.flow_fields,
                task.count_threshold, task.size_threshold,
            )
            for task in votes
        ]
    timed = with_snapshot_times(packets, "ts", interval, period, origin)
    for task in tasks:
        if task.kind != VOTE_SKETCH:
            sketches = timed.groupBy(
                F.lit(task.name).alias("task_name"),
                flow_label(task.flow_fields).alias("flow"),
                "period_start",
                "snapshot_ts",
            ).agg(F.hll_sketch_agg(flow_key(task.element_fields), task.lg_k).alias("sketch"))
            rows.append(spreads_at_snapshots(sketches, task.count_threshold))
    return reduce(DataFrame.unionByName, rows)


def _repeat_until_next(
    running: DataFrame,
    packets: DataFrame,
    interval: timedelta,
    period: timedelta,
    origin: datetime,
    until: datetime | str | Column | None,
) -> DataFrame:
    """Each row at every snapshot before the flow's next row or the end of its period."""
    if until is None:
        last = with_snapshot_times(
            packets.agg(F.max("ts").alias("ts")), "ts", interval, period, origin
        )
        until = last.select("snapshot_ts").scalar()
    step = F.lit(interval)
    period_end = F.col("period_start") + F.lit(period)
    # Snapshot times are the grid ticks inside the period and the period's end.
    last_tick = F.least(
        F.coalesce(F.col("_next") - F.lit(timedelta(microseconds=1)), period_end), ntz(until)
    )
    ticks = F.when(
        last_tick > F.col("snapshot_ts"), F.sequence("snapshot_ts", last_tick, step)
    ).otherwise(F.array("snapshot_ts"))
    closing = (last_tick == period_end) & (F.element_at(ticks, -1) < period_end)
    all_ticks = F.when(closing, F.array_append(ticks, period_end)).otherwise(ticks)
    return running.withColumn("snapshot_ts", F.explode(all_ticks)).drop("_next")


# A time and a 64-bit value as one decimal of 38 digits, in their order: the value takes the
# lower 20 digits, moved so that it is positive, and 0 stands for none.
VALUE_DIGITS = Decimal(10**20)
VALUE_OFFSET = Decimal(2**63 + 1)
# Microseconds of every timestamp are above the negative of this.
TIME_OFFSET = 10**17


def newest_values(
    rows: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "snapshot_ts"
) -> DataFrame:
    """Keys, the largest `at` of each and the `values`, integers or times, of that moment.

    Where rows of one key share the newest time, each value is the largest of theirs; nulls
    come before all values, and a null time before all times. Every value is the maximum of
    one decimal with the time in front of it, a fixed-width buffer of a hash aggregate that
    is combined before the shuffle.
    """
    digits, offset = F.lit(VALUE_DIGITS), F.lit(VALUE_OFFSET)
    types = {name: rows.schema[name].dataType.simpleString() for name in values}
    moment = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) + TIME_OFFSET, F.lit(0))
    front = (moment.cast("decimal(18,0)") * digits).cast("decimal(38,0)")

    def packed(name: str) -> Column:
        value = F.col(name)
        if types[name].startswith("timestamp"):
            value = F.unix_micros(value.cast("timestamp"))
        place = F.coalesce(value.cast("decimal(19,0)") + offset, F.lit(0))
        return F.max((front + place).cast("decimal(38,0)")).alias(name)

    def unpacked(name: str) -> Column:
        place = (F.col(name) % digits).cast("decimal(20,0)")
        value = F.when(place > 0, (place - offset).cast("bigint"))
        if types[name].startswith("timestamp"):
            value = F.timestamp_micros(value)
        return value.cast(types[name]).alias(name)

    newest = rows.groupBy(*keys).agg(F.max(at).alias("_at"), *[packed(name) for name in values])
    return newest.select(*keys, F.col("_at").alias(at), *[unpacked(name) for name in values])


def latest_per_flow(
    flow_metrics: DataFrame,
    values: Sequence[str] = ("byte_count", "packet_count", "start_time", "end_time", "period_start"),
) -> DataFrame:
    """The newest row per task and five-tuple; unused (NULL) keys group together.

    Equal times are settled by the larger values, so a replayed or re-emitted
    snapshot cannot make the answer depend on row order.
    """
    newest = newest_values(flow_metrics, ["task_name", *KEY_TYPES], values)
    return newest.select("task_name", *KEY_TYPES, "snapshot_ts", *values)
