"""Exact aggregation of packets into flows.

All aggregates are `min`, `max`, `sum` and `count`: Spark combines them inside
each scan task before the shuffle, so a key that holds a third of all packets
reaches the reducers as one row per scan task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.keys import flow_label, pad_missing_keys
from flowloom.model import COUNT, FIVE_TUPLE, KEY_TYPES, SIZE, ExactTask, key_columns

# Above this many distinct key sets, packets are first reduced to their finest
# flows and the key sets are rolled up from there: GROUPING SETS copies every
# input row once per set.
ROLL_UP_FROM = 4

METRICS = {"packets": "packet_count", "bytes": "byte_count"}


def packet_measures() -> list[Column]:
    """Start, end, bytes and packets of a group of packets."""
    return [
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.sum("length").alias("byte_count"),
        F.count(F.lit(1)).alias("packet_count"),
    ]


def flow_measures() -> list[Column]:
    """The same four measures, rolled up from finer flows."""
    return [
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("byte_count").alias("byte_count"),
        F.sum("packet_count").alias("packet_count"),
    ]


def flow_aggregate(packets: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Start, end, bytes and packets per flow."""
    return packets.groupBy(*key_columns(fields)).agg(*packet_measures())


def multi_task_aggregate(
    packets: DataFrame,
    tasks: Sequence[ExactTask],
    roll_up: bool | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Flows of every task from one scan of the packets, tagged with task_name.

    Tasks with the same key set share one grouping set and are told apart after
    aggregation. `roll_up` forces or forbids reducing to the finest flows first.
    `by` names further columns that every task groups by, such as a time cell.
    """
    if not tasks:
        raise ValueError("no tasks")
    names = [task.name for task in tasks]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated task name in {names}")

    used = [name for name in key_columns(FIVE_TUPLE) if any(name in task.keys for task in tasks)]
    tasks_of: dict[frozenset, list[str]] = {}
    for task in tasks:
        tasks_of.setdefault(frozenset(task.keys), []).append(task.name)

    if len(tasks_of) == 1:
        flows = packets.groupBy(*used, *by).agg(*packet_measures())
        owners = F.array(*map(F.lit, names))
    else:
        flows, owners = _grouping_sets(packets, used, tasks_of, roll_up, by)
    tagged = flows.withColumn("task_name", F.explode(owners))
    fields = [field for field in FIVE_TUPLE if key_columns([field])[0] in used]
    measures = ["start_time", "end_time", "byte_count", "packet_count"]
    return pad_missing_keys(tagged, fields).select("task_name", *KEY_TYPES, *by, *measures)


def _grouping_sets(
    packets: DataFrame,
    used: Sequence[str],
    tasks_of: Mapping[frozenset, Sequence[str]],
    roll_up: bool | None,
    by: Sequence[str],
) -> tuple[DataFrame, Column]:
    """Flows of all key sets at once, and the tasks that each row belongs to."""
    if roll_up is None:
        roll_up = len(tasks_of) > ROLL_UP_FROM
    rows, measures = packets, packet_measures()
    if roll_up:
        rows, measures = packets.groupBy(*used, *by).agg(*packet_measures()), flow_measures()

    always = [F.col(name) for name in by]
    sets = [always + [F.col(name) for name in used if name in keys] for keys in tasks_of]
    flows = rows.groupingSets(sets, *always, *[F.col(name) for name in used]).agg(
        F.grouping_id().alias("grouping"), *measures
    )

    def grouping(keys: frozenset) -> Column:
        """grouping_id: a bit per column, set where the column is not in the set."""
        bits = "".join("0" if name in keys else "1" for name in used)
        return F.lit(int(bits, 2)).cast("bigint")

    owners = F.create_map(
        *[
            item
            for keys, names in tasks_of.items()
            for item in (grouping(keys), F.array(*map(F.lit, names)))
        ]
    )
    return flows, owners[F.col("grouping")]


def snapshot_totals(flows: DataFrame) -> DataFrame:
    """Number of flows, bytes and packets per task."""
    return flows.groupBy("task_name").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("byte_count").alias("total_bytes"),
        F.sum("packet_count").alias("total_packets"),
    )


def _metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}, expected one of {sorted(METRICS)}")
    return METRICS[metric]


def exact_heavy_hitters(
    packets: DataFrame, fields: Iterable[str], metric: str, threshold: int
) -> DataFrame:
    """(flow, value, type) of the flows with at least `threshold` packets or bytes."""
    column = _metric(metric)
    fields = list(fields)
    value = F.count(F.lit(1)) if column == "packet_count" else F.sum("length")
    return (
        packets.groupBy(*key_columns(fields))
        .agg(value.alias("value"))
        .where(F.col("value") >= threshold)
        .select(
            flow_label(fields).alias("flow"),
            "value",
            F.lit(COUNT if column == "packet_count" else SIZE).alias("type"),
        )
    )


def top_n(packets: DataFrame, field: str, n: int, metric: str = "bytes") -> DataFrame:
    """The n addresses, ports or protocols with most packets or bytes."""
    (column,) = key_columns([field])
    value = F.count(F.lit(1)) if _metric(metric) == "packet_count" else F.sum("length")
    return (
        packets.groupBy(column)
        .agg(value.alias("value"))
        .orderBy(F.desc("value"), F.asc(column))
        .limit(n)
    )


def exact_spread(
    packets: DataFrame, flow_fields: Iterable[str], element_fields: Iterable[str]
) -> DataFrame:
    """Number of distinct elements per flow.

    Spark removes duplicate (flow, element) pairs before and after a shuffle on
    the pair, so one flow with very many elements is spread over all reducers.
    Packet keys are never NULL; rows with a NULL element field would not count.
    """
    flow_fields = list(flow_fields)
    return (
        packets.groupBy(*key_columns(flow_fields))
        .agg(F.count_distinct(*[F.col(c) for c in key_columns(element_fields)]).alias("spread"))
        .select(flow_label(flow_fields).alias("flow"), "spread")
    )
