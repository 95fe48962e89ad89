"""Timestamps: unix nanoseconds, snapshot labels, event-time grids, log lines.

The session time zone is UTC (see `session.prepare`), so casts between zoned
and zone-free timestamps keep the wall clock.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and log-line formats, and the log line of a packet.
LABEL_FORMAT = "yyyy-MM-dd_HH-mm-ss"
LINE_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
MONTH_FORMAT = "yyyyMM"
PACKET_LINE = "%s - %s:%d -> %s:%d, Proto: %d, Len: %d"

EPOCH = datetime(1970, 1, 1)


def ntz(value: datetime | str | Column) -> Column:
    """A zone-free timestamp literal that reaches the Parquet scan as a filter."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def nanos_to_ts(nanos: Column) -> Column:
    """Unix nanoseconds to a timestamp, rounded down to the microsecond."""
    micros = F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000))
    return F.timestamp_micros(micros)


def ts_to_nanos(ts: Column) -> Column:
    """Timestamp to unix nanoseconds."""
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def snapshot_label(ts: Column) -> Column:
    return F.date_format(ts, LABEL_FORMAT)


def parse_snapshot_label(label: Column) -> Column:
    return F.to_timestamp_ntz(label, F.lit(LABEL_FORMAT))


def month_of(ts: Column) -> Column:
    """Month partition value of a snapshot time."""
    return F.date_format(ts, MONTH_FORMAT)


def flow_duration(start: Column, end: Column) -> Column:
    """Microseconds between the first and the last packet of a flow."""
    return F.timestamp_diff("MICROSECOND", start, end)


def packet_line() -> Column:
    """Log line of one packet."""
    return F.format_string(
        PACKET_LINE,
        F.date_format("ts", LINE_FORMAT),
        "src_ip",
        "src_port",
        "dst_ip",
        "dst_port",
        "protocol",
        "length",
    )


def grid(ts: str, step: timedelta, origin: datetime = EPOCH) -> Column:
    """The [start, end) cell of an event-time grid that holds `ts`."""
    micros = timedelta(microseconds=1)
    width = f"{step // micros} microseconds"
    shift = f"{((origin - EPOCH) % step) // micros} microseconds"
    return F.window(ts, width, width, shift)
