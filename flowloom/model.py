"""Schemas of the packet and result tables, and the task and rule definitions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The public names of the five key fields and their columns.
KEY_COLUMNS = {
    "SrcIP": "src_ip",
    "DstIP": "dst_ip",
    "SrcPort": "src_port",
    "DstPort": "dst_port",
    "Protocol": "protocol",
}
FIVE_TUPLE = tuple(KEY_COLUMNS)
KEY_TYPES = {
    "src_ip": T.StringType(),
    "dst_ip": T.StringType(),
    "src_port": T.IntegerType(),
    "dst_port": T.IntegerType(),
    "protocol": T.IntegerType(),
}

# Protocol numbers that carry ports, and the hitter type codes.
TCP, UDP = 6, 17
COUNT, SIZE, SPREAD = 0, 1, 2

# Rule metrics and operators.
TOTAL_METRICS = ("total_packets", "total_bytes", "total_flows")
HITTER_METRICS = ("heavy_hitter_count", "heavy_hitter_size", "super_spreader_spread")
RULE_OPERATORS = (">", "<", "=", ">=", "<=")

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(name, kind) for name, kind in KEY_TYPES.items()],
        T.StructField("length", T.LongType()),
    ]
)

WIRE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp_unix_nano", T.LongType()),
        T.StructField(
            "five_tuple",
            T.StructType([T.StructField(name, kind) for name, kind in KEY_TYPES.items()]),
        ),
        T.StructField("length", T.LongType()),
    ]
)

FLOW_METRICS_SCHEMA = T.StructType(
    [
        T.StructField("snapshot_ts", T.TimestampNTZType()),
        T.StructField("task_name", T.StringType()),
        *[T.StructField(name, kind) for name, kind in KEY_TYPES.items()],
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("byte_count", T.LongType()),
        T.StructField("packet_count", T.LongType()),
        T.StructField("period_start", T.TimestampNTZType()),
    ]
)

HEAVY_HITTERS_SCHEMA = T.StructType(
    [
        T.StructField("snapshot_ts", T.TimestampNTZType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("flow", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("type", T.IntegerType()),
    ]
)

SPREAD_SKETCHES_SCHEMA = T.StructType(
    [
        T.StructField("snapshot_ts", T.TimestampNTZType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("flow", T.StringType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("period_start", T.TimestampNTZType()),
    ]
)

RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule_name", T.StringType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
    ]
)


def key_columns(fields: Iterable[str]) -> list[str]:
    """Column names of the given key fields, in order; unknown names are an error."""
    names = list(fields)
    unknown = [name for name in names if name not in KEY_COLUMNS]
    if unknown:
        raise ValueError(f"unknown key field: {', '.join(unknown)}")
    if len(set(names)) != len(names):
        raise ValueError(f"repeated key field in {names}")
    return [KEY_COLUMNS[name] for name in names]


@dataclass(frozen=True)
class ExactTask:
    """Exact per-flow counting over a subset of the key fields."""

    name: str
    key_fields: Sequence[str]

    def __post_init__(self):
        key_columns(self.key_fields)
        if not self.key_fields:
            raise ValueError(f"task {self.name}: no key fields")

    @property
    def keys(self) -> list[str]:
        return key_columns(self.key_fields)


# Sketch defaults, chosen by a zero in the definition.
VOTE_DEFAULTS = {"width": 1 << 20, "depth": 3, "size_threshold": 512 * 1024, "count_threshold": 512}
SPREAD_DEFAULTS = {"width": 1 << 20, "depth": 3, "count_threshold": 4096, "m": 128, "size": 5}
VOTE_SKETCH, SPREAD_SKETCH = 0, 1


@dataclass(frozen=True)
class SketchTask:
    """Approximate counting: vote sketch (kind 0) or spread sketch (kind 1)."""

    name: str
    kind: int
    flow_fields: Sequence[str]
    element_fields: Sequence[str] = ()
    width: int = 0
    depth: int = 0
    size_threshold: int = 0
    count_threshold: int = 0
    m: int = 0
    size: int = 0

    def __post_init__(self):
        if self.kind not in (VOTE_SKETCH, SPREAD_SKETCH):
            raise ValueError(f"task {self.name}: unknown sketch kind {self.kind}")
        key_columns(self.flow_fields)
        key_columns(self.element_fields)
        if not self.flow_fields:
            raise ValueError(f"task {self.name}: no flow fields")
        if self.kind == SPREAD_SKETCH and not self.element_fields:
            raise ValueError(f"task {self.name}: a spread sketch needs element fields")
        defaults = VOTE_DEFAULTS if self.kind == VOTE_SKETCH else SPREAD_DEFAULTS
        for name, value in defaults.items():
            if getattr(self, name) == 0:
                object.__setattr__(self, name, value)
        if self.kind == SPREAD_SKETCH and self.m & (self.m - 1):
            raise ValueError(f"task {self.name}: m must be a power of two")

    @property
    def lg_k(self) -> int:
        """log2 of the register count m."""
        return self.m.bit_length() - 1


@dataclass(frozen=True)
class AlertRule:
    """Fires when `metric` of `task_name` compares with `threshold` by `operator`."""

    name: str
    task_name: str
    metric: str
    operator: str
    threshold: float

    def problems(self) -> list[str]:
        """What keeps this rule from ever firing; empty for a sound rule."""
        found = []
        if self.metric not in TOTAL_METRICS + HITTER_METRICS:
            found.append(f"rule {self.name}: unknown metric {self.metric}")
        if self.operator not in RULE_OPERATORS:
            found.append(f"rule {self.name}: unknown operator {self.operator}")
        return found


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Rows of the driver as a table whose size Spark knows when it plans joins.

    Built through Arrow, which gives a local relation; rows alone would become a
    distributed table of unknown size.
    """
    columns = zip(*rows) if rows else [()] * len(schema)
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(column, field.type) for column, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.table(arrays, schema=arrow), schema)


def rules_frame(spark: SparkSession, rules: Iterable[AlertRule]) -> DataFrame:
    """Rules as rows. Rules with problems stay in the table and never fire."""
    rows = [(r.name, r.task_name, r.metric, r.operator, float(r.threshold)) for r in rules]
    return small_table(spark, rows, RULES_SCHEMA)
