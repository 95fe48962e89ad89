"""Row filters that reach the scan as pushed-down predicates."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.times import month_of, ntz
from flowloom.model import KEY_TYPES, key_columns


def filter_ip(packets: DataFrame) -> DataFrame:
    """IPv4 and IPv6 packets only."""
    return packets.where(F.col("ip_version").isin(4, 6))


def filter_flows(
    flow_metrics: DataFrame,
    task: str | None = None,
    src_ip: str | None = None,
    dst_ip: str | None = None,
    src_port: int | None = None,
    dst_port: int | None = None,
    protocol: int | None = None,
) -> DataFrame:
    """Equality filters joined by AND. None and empty text do not filter; port 0 does."""
    texts = {"task_name": task, "src_ip": src_ip, "dst_ip": dst_ip}
    numbers = {"src_port": src_port, "dst_port": dst_port, "protocol": protocol}
    wanted = {name: value for name, value in texts.items() if value}
    wanted |= {name: value for name, value in numbers.items() if value is not None}
    for name, value in wanted.items():
        flow_metrics = flow_metrics.where(F.col(name) == F.lit(value))
    return flow_metrics


def filter_flow_keys(flow_metrics: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Key field = text, for names among the five; the text takes the column's type."""
    names = sorted(keys)
    for name, column in zip(names, key_columns(names)):
        value = F.lit(keys[name]).cast(KEY_TYPES[column])
        flow_metrics = flow_metrics.where(F.col(column) == value)
    return flow_metrics


def as_of(table: DataFrame, end: datetime | str | Column | None) -> DataFrame:
    """Rows with snapshot_ts <= end; None is unbounded.

    A stored table is partitioned by month, which a filter on snapshot_ts alone
    cannot prune, so the month is bounded as well.
    """
    if end is None:
        return table
    bound = ntz(end)
    if "month" in table.columns:
        table = table.where(F.col("month") <= month_of(bound))
    return table.where(F.col("snapshot_ts") <= bound)


def filter_hitters(heavy_hitters: DataFrame, task: str, hitter_type: int) -> DataFrame:
    """Rows of one task and hitter type."""
    return heavy_hitters.where((F.col("task_name") == task) & (F.col("type") == hitter_type))
