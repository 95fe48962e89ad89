"""The offline job: captures through all tasks into tables and closing alerts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.times import EPOCH
from flowloom.model import AlertRule, ExactTask, SketchTask, rules_frame
from flowloom.operators.alerts import alert_digest, alert_messages
from flowloom.operators.snapshots import cumulative_snapshots, sketch_snapshots
from flowloom.sinks.tables import (
    heavy_hitters_scan,
    write_alerts,
    write_flow_metrics,
    write_heavy_hitters,
)
from flowloom.sources.captures import pcap_scan
from flowloom.sources.packets import flow_metrics_scan
from flowloom.streaming.flows import current_alerts

WRITER = "offline"


def offline_job(
    spark: SparkSession,
    captures: str,
    base: str,
    exact: Sequence[ExactTask],
    sketches: Sequence[SketchTask],
    rules: Sequence[AlertRule],
    interval: timedelta,
    period: timedelta,
    origin: datetime = EPOCH,
) -> datetime | None:
    """Run all tasks over the capture files of a folder; the time of the last snapshot.

    Captures are decoded once, into `packets` under `base`; every task reads that table.
    Snapshots go to `flow_metrics` and `heavy_hitters`, and the alerts of the last period,
    as of its last snapshot, to `alerts`. A job that is run again on the same `base` replaces
    its own rows. Without any packet there are tables without rows, no check and no time.
    """
    paths = {name: f"{base.rstrip('/')}/{name}" for name in ("packets", "flow_metrics", "heavy_hitters", "alerts")}
    pcap_scan(spark, captures).write.mode("overwrite").parquet(paths["packets"])
    packets = spark.read.parquet(paths["packets"])
    if exact:
        write_flow_metrics(
            cumulative_snapshots(packets, list(exact), interval, period, origin),
            paths["flow_metrics"], WRITER,
        )
    if sketches:
        write_heavy_hitters(
            sketch_snapshots(packets, list(sketches), interval, period, origin),
            paths["heavy_hitters"], WRITER,
        )
    last = packets.agg(F.max("ts").alias("ts")).first().ts
    if last is None:
        return None
    began = origin + (last - origin) // period * period
    closed = min(began + ((last - began) // interval + 1) * interval, began + period)
    metrics = flow_metrics_scan(spark, paths["flow_metrics"])
    hitters = heavy_hitters_scan(spark, paths["heavy_hitters"])
    alerts = current_alerts(
        metrics, hitters, rules_frame(spark, list(rules)), closed, period, origin, began
    )
    write_alerts(alert_digest(alert_messages(alerts)), paths["alerts"], WRITER)
    return closed


def closing_alerts(spark: SparkSession, base: str) -> DataFrame:
    """The alert lines that `offline_job` wrote under `base`."""
    return spark.read.parquet(f"{base.rstrip('/')}/alerts").drop("writer", "batch_id")
