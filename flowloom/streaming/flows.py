"""Continuous flows, snapshots, hitters, spreads, alerts and the raw archive.

The state of a stream is one row per task, flow and snapshot interval, in event time.
Queries run in update mode: a micro-batch emits the totals of the intervals that it
changed, and a stored table keeps every version. Reading takes the newest version of each
interval and sums up within the period, so at every snapshot, not only the last, the result
equals that of the batch operators, also after a backlog of many intervals and after late
packets. The watermark bounds the state: packets later than that are dropped and counted
in the query's progress.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.functions.keys import flow_key, flow_label
from flowloom.functions.times import EPOCH, grid, month_of, ntz
from flowloom.model import (
    KEY_TYPES,
    VOTE_SKETCH,
    ExactTask,
    SketchTask,
    key_columns,
)
from flowloom.operators.alerts import (
    alert_digest,
    alert_messages,
    alerts_hitters,
    alerts_spread,
    alerts_totals,
)
from flowloom.operators.flows import packet_measures
from flowloom.operators.snapshots import (
    hitters_at_snapshots,
    latest_per_flow,
    newest_values,
    running_totals,
    spreads_at_snapshots,
)
from flowloom.sinks.tables import (
    spread_sketches_scan,
    write_alerts,
    write_flow_metrics,
    write_spread_sketches,
)
from flowloom.sources.packets import flow_metrics_scan

LATENESS = timedelta(hours=1)
Tasks = ExactTask | SketchTask | Sequence[ExactTask | SketchTask]


def _text(span: timedelta) -> str:
    return f"{span // timedelta(microseconds=1)} microseconds"


def _period_start(period: timedelta, origin: datetime) -> Column:
    """Start of the period that holds `ts`. Arithmetic, for a stream has one window."""
    micro = timedelta(microseconds=1)
    past = F.pmod(F.unix_micros("ts") - F.lit((origin - EPOCH) // micro), F.lit(period // micro))
    return F.timestamp_micros(F.unix_micros("ts") - past)


def _listed(tasks: Tasks) -> list[ExactTask | SketchTask]:
    return [tasks] if isinstance(tasks, ExactTask | SketchTask) else list(tasks)


def _fields(task: ExactTask | SketchTask) -> Sequence[str]:
    return task.key_fields if isinstance(task, ExactTask) else task.flow_fields


def _per_task(packets: DataFrame, rows: list[Column]) -> DataFrame:
    """Every packet once per task, with the columns of the task's struct."""
    return packets.select("*", F.explode(F.array(*rows)).alias("_task"))


def stream_flows(
    packets: DataFrame,
    tasks: Tasks,
    interval: timedelta,
    period: timedelta,
    origin: datetime = EPOCH,
    lateness: timedelta = LATENESS,
) -> DataFrame:
    """Totals per task, flow and interval of a period; the interval as `window`."""
    rows = [
        F.struct(
            F.lit(task.name).alias("task_name"),
            *(
                (F.col(name) if name in key_columns(_fields(task)) else F.lit(None))
                .cast(kind)
                .alias(name)
                for name, kind in KEY_TYPES.items()
            ),
        )
        for task in _listed(tasks)
    ]
    return (
        _per_task(packets.withWatermark("ts", _text(lateness)), rows)
        .withColumn("period_start", _period_start(period, origin))
        .groupBy(
            grid("ts", interval, origin).alias("window"),
            "period_start",
            "_task.task_name",
            *(F.col(f"_task.{name}").alias(name) for name in KEY_TYPES),
        )
        .agg(*packet_measures())
    )


def spread_state(
    packets: DataFrame,
    tasks: Tasks,
    interval: timedelta,
    period: timedelta,
    origin: datetime = EPOCH,
    lateness: timedelta = LATENESS,
) -> DataFrame:
    """One HyperLogLog sketch per task, flow and interval, kept as streaming state.

    The tasks of one call share their number of registers.
    """
    tasks = _listed(tasks)
    (lg_k,) = {task.lg_k for task in tasks}
    rows = [
        F.struct(
            F.lit(task.name).alias("task_name"),
            flow_label(task.flow_fields).alias("flow"),
            flow_key(task.element_fields).alias("element"),
        )
        for task in tasks
    ]
    return (
        _per_task(packets.withWatermark("ts", _text(lateness)), rows)
        .withColumn("period_start", _period_start(period, origin))
        .groupBy(
            grid("ts", interval, origin).alias("window"),
            "period_start",
            "_task.task_name",
            F.col("_task.flow").alias("flow"),
        )
        .agg(F.hll_sketch_agg("_task.element", lg_k).alias("sketch"))
    )


def _stamped(rows: DataFrame, period: timedelta) -> DataFrame:
    """Rows with zone-free times and the snapshot that closes their interval."""
    times = [name for name in ("start_time", "end_time", "period_start") if name in rows.columns]
    zone_free = rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name in times})
    end = F.col("window.end").cast("timestamp_ntz")
    return zone_free.withColumn(
        "snapshot_ts", F.least(end, F.col("period_start") + F.lit(period))
    ).drop("window")


def _start(
    stream: DataFrame,
    write_batch: Callable[[DataFrame, str, int], None],
    checkpoint: str,
    every: timedelta | None,
    name: str,
) -> StreamingQuery:
    # A stream with a new checkpoint numbers its batches anew and is another writer.
    writer_name = f"{name}-{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}"
    writer = (
        stream.writeStream.queryName(name)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: write_batch(batch, writer_name, batch_id))
    )
    # Without an interval the query drains what has arrived and stops: the closing
    # snapshot at shutdown.
    trigger = {"processingTime": _text(every)} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_snapshots(
    packets: DataFrame,
    tasks: Tasks,
    interval: timedelta,
    period: timedelta,
    path: str,
    checkpoint: str,
    origin: datetime = EPOCH,
    lateness: timedelta = LATENESS,
    every: timedelta | None = None,
) -> StreamingQuery:
    """Write the interval totals of all tasks; `streamed_snapshots` reads them.

    One query reads the packets once for all tasks. `every` is the time between its
    batches; None drains the source and stops.
    """

    def write_batch(changed: DataFrame, writer: str, batch_id: int) -> None:
        write_flow_metrics(_stamped(changed, period), path, writer, batch_id)

    flows = stream_flows(packets, tasks, interval, period, origin, lateness)
    names = "-".join(task.name for task in _listed(tasks))
    return _start(flows, write_batch, checkpoint, every, f"flows-{names}")


def interval_totals(table: DataFrame) -> DataFrame:
    """The newest version of every interval of a streamed table.

    Totals only grow from version to version, so the newest is the largest.
    """
    return table.groupBy("task_name", *KEY_TYPES, "period_start", "snapshot_ts").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max("byte_count").alias("byte_count"),
        F.max("packet_count").alias("packet_count"),
    )


def streamed_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative snapshots (flow_metrics rows) of a table that `stream_snapshots` writes."""
    return running_totals(interval_totals(flow_metrics_scan(spark, path)))


def stream_close(start: Callable[..., StreamingQuery], *args, **kwargs) -> None:
    """Drain what is waiting, write the final snapshot and stop."""
    start(*args, **{**kwargs, "every": None}).awaitTermination()


# Vote tasks keep the totals of their flows: state spills to disk, so they are exact and
# need no sketch to bound memory.
stream_hitters = stream_snapshots


def streamed_hitters(spark: SparkSession, path: str, task: SketchTask) -> DataFrame:
    """heavy_hitters rows of a vote task at every snapshot that its flows changed."""
    table = flow_metrics_scan(spark, path).where(F.col("task_name") == task.name)
    return hitters_at_snapshots(
        running_totals(interval_totals(table)),
        task.name,
        task.flow_fields,
        task.count_threshold,
        task.size_threshold,
    )


def stream_spread(
    packets: DataFrame,
    tasks: Tasks,
    interval: timedelta,
    period: timedelta,
    path: str,
    checkpoint: str,
    origin: datetime = EPOCH,
    lateness: timedelta = LATENESS,
    every: timedelta | None = None,
) -> StreamingQuery:
    """Write the interval sketches of spread tasks; `streamed_spreads` reads them."""

    def write_batch(changed: DataFrame, writer: str, batch_id: int) -> None:
        write_spread_sketches(_stamped(changed, period), path, writer, batch_id)

    state = spread_state(packets, tasks, interval, period, origin, lateness)
    names = "-".join(task.name for task in _listed(tasks))
    return _start(state, write_batch, checkpoint, every, f"spread-{names}")


def streamed_spreads(spark: SparkSession, path: str, task: SketchTask) -> DataFrame:
    """heavy_hitters rows of a spread task at every snapshot that its flows changed."""
    table = spread_sketches_scan(spark, path).where(F.col("task_name") == task.name)
    return spreads_at_snapshots(table, task.count_threshold)


def stream_alerts(
    ticks: DataFrame,
    rules: DataFrame,
    read_flow_metrics: Callable[[], DataFrame],
    read_heavy_hitters: Callable[[], DataFrame],
    alerts_path: str,
    checkpoint: str,
    period: timedelta,
    origin: datetime = EPOCH,
    every: timedelta | None = None,
) -> StreamingQuery:
    """Check the rules against the snapshots of the current period at every tick.

    `ticks` is any stream with an event time `ts`; a batch of it triggers one check as of
    its last time. The packets themselves tick while there are any, a rate source ticks by
    the clock. The tables are read anew at each check, stored or streamed ones alike.
    """

    def check_rules(batch: DataFrame, writer: str, batch_id: int) -> None:
        # One value per batch: the time of this check.
        checked_at = batch.agg(F.max("ts").cast("timestamp_ntz").alias("at")).first().at
        if checked_at is None:
            return
        alerts = current_alerts(
            read_flow_metrics(), read_heavy_hitters(), rules, checked_at, period, origin
        )
        write_alerts(alert_digest(alert_messages(alerts)), alerts_path, writer, batch_id)

    return _start(ticks.select("ts"), check_rules, checkpoint, every, "alerts")


def current_alerts(
    flow_metrics: DataFrame,
    heavy_hitters: DataFrame,
    rules: DataFrame,
    checked_at: datetime,
    period: timedelta,
    origin: datetime = EPOCH,
    began: datetime | None = None,
) -> DataFrame:
    """Alerts of all rules as of `checked_at`, on the snapshots of its period.

    A snapshot counts from its own time on. The period bounds what is read: where a table
    has months, they reach the scan. Its start may be given as `began`, for a check at the
    very end of a period.
    """
    if began is None:
        began = origin + (checked_at - origin) // period * period

    def current(table: DataFrame) -> DataFrame:
        if "month" in table.columns:
            months = month_of(ntz(began)), month_of(ntz(checked_at))
            table = table.where(F.col("month").between(*months))
        ts = F.col("snapshot_ts")
        return table.where((ts > ntz(began)) & (ts <= ntz(checked_at)))

    flows = latest_per_flow(current(flow_metrics).where(F.col("period_start") == ntz(began)))
    hitters = newest_values(current(heavy_hitters), ["task_name", "type", "flow"], ["value"])
    return (
        alerts_totals(flows, rules, checked_at)
        .unionByName(alerts_hitters(hitters, rules, checked_at))
        .unionByName(alerts_spread(hitters, rules, checked_at))
    )


def stream_archive(
    packets: DataFrame, path: str, checkpoint: str, every: timedelta | None = None
) -> StreamingQuery:
    """Keep every raw packet as Parquet next to the aggregation; nothing is dropped."""
    trigger = {"processingTime": _text(every)} if every else {"availableNow": True}
    return (
        packets.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        .writeStream.queryName("archive")
        .outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def stream_tasks(
    packets: DataFrame,
    exact: Iterable[ExactTask],
    sketch: Iterable[SketchTask],
    interval: timedelta,
    period: timedelta,
    base: str,
    origin: datetime = EPOCH,
    lateness: timedelta = LATENESS,
    every: timedelta | None = None,
) -> list[StreamingQuery]:
    """Start all tasks on one packet stream.

    Exact and vote tasks share one query and its read of the packets, spread tasks one per
    number of registers. Tables are `flow_metrics` and `spreads` under `base`.
    """
    sketch = list(sketch)
    common = {
        "interval": interval, "period": period, "origin": origin, "lateness": lateness,
        "every": every,
    }
    counted = [*exact, *(task for task in sketch if task.kind == VOTE_SKETCH)]
    spreads: dict[int, list[SketchTask]] = {}
    for task in sketch:
        if task.kind != VOTE_SKETCH:
            spreads.setdefault(task.lg_k, []).append(task)
    started = []
    if counted:
        started.append(
            stream_snapshots(
                packets, counted, path=f"{base}/flow_metrics",
                checkpoint=f"{base}/checkpoints/flows", **common,
            )
        )
    for lg_k, tasks in spreads.items():
        started.append(
            stream_spread(
                packets, tasks, path=f"{base}/spreads",
                checkpoint=f"{base}/checkpoints/spreads-{lg_k}", **common,
            )
        )
    return started
