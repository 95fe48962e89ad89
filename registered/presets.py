"""Tasks, rules and stored-table shapes that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.keys import flow_label
from flowloom.model import (
    COUNT,
    FIVE_TUPLE,
    SIZE,
    SPREAD,
    SPREAD_SKETCH,
    VOTE_SKETCH,
    AlertRule,
    ExactTask,
    SketchTask,
)
from flowloom.operators.snapshots import cumulative_snapshots, with_snapshot_times
from registered.views import DAY, EVENTS, KEYS, ORIGIN, PERIOD, event_packets

EXACT = [
    ExactTask("flows_by_tuple", FIVE_TUPLE),
    ExactTask("per_src_ip", ["SrcIP"]),
    ExactTask("per_dst_ip", ["DstIP"]),
]
VOTE = SketchTask(
    "votes_by_source",
    VOTE_SKETCH,
    ["SrcIP"],
    ["DstIP", "SrcPort", "DstPort", "Protocol"],
    width=256,
    depth=2,
    size_threshold=7500,
    count_threshold=75,
)
SPREADERS = SketchTask(
    "spread_by_source", SPREAD_SKETCH, ["SrcIP"], ["DstIP"], count_threshold=50, m=128
)

RULES = [
    AlertRule("wide_spread", "spread_by_source", "super_spreader_spread", ">", 55),
    AlertRule("spread_as_count", "spread_by_source", "heavy_hitter_count", ">=", 60),
    AlertRule("many_packets", "votes_by_source", "heavy_hitter_count", ">", 80),
    AlertRule("many_bytes", "votes_by_source", "heavy_hitter_size", ">=", 8000),
    AlertRule("traffic_spike", "flows_by_tuple", "total_bytes", ">", 500000),
    AlertRule("flow_spike", "per_src_ip", "total_flows", "<=", 100000000),
    AlertRule("quiet", "per_src_ip", "total_packets", "<", 1),
    AlertRule("unknown_metric", "per_src_ip", "ByteCount", ">", 0),
    AlertRule("unknown_operator", "per_src_ip", "total_bytes", "!=", 0),
]


def rules_sql(rules: list[AlertRule]) -> str:
    """Rules as a common table expression."""
    rows = ", ".join(
        f"('{r.name}', '{r.task_name}', '{r.metric}', '{r.operator}', CAST({r.threshold} AS DOUBLE))"
        for r in rules
    )
    return f"rules AS (SELECT * FROM (VALUES {rows}) v(rule_name, task_name, metric, op, threshold))"


RULES_SQL = rules_sql(RULES)
FIRES_SQL = (
    "CASE r.op WHEN '>' THEN v.value > r.threshold WHEN '<' THEN v.value < r.threshold "
    "WHEN '=' THEN v.value = r.threshold WHEN '>=' THEN v.value >= r.threshold "
    "WHEN '<=' THEN v.value <= r.threshold ELSE false END"
)
CHECKED_AT = "2024-02-01 00:00:00"

# Values a source must reach at a snapshot to be reported as a hitter.
REPORT_COUNT, REPORT_SIZE = 20, 2000


def flow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cumulative snapshots of the exact tasks over the events."""
    return cumulative_snapshots(event_packets(spark, sf_dir), EXACT, DAY, PERIOD, ORIGIN)


def task_metrics(spark: SparkSession, sf_dir: str, task: ExactTask) -> DataFrame:
    return cumulative_snapshots(event_packets(spark, sf_dir), task, DAY, PERIOD, ORIGIN)


def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources over the reporting values at each snapshot, and their daily spread."""
    sources = task_metrics(spark, sf_dir, EXACT[1])
    measures = F.explode(
        F.array(
            F.struct(F.lit(COUNT).alias("type"), F.col("packet_count").alias("value")),
            F.struct(F.lit(SIZE).alias("type"), F.col("byte_count").alias("value")),
        )
    )
    reached = F.when(F.col("type") == COUNT, REPORT_COUNT).otherwise(REPORT_SIZE)
    hitters = (
        sources.select(
            "snapshot_ts",
            F.lit(VOTE.name).alias("task_name"),
            flow_label(["SrcIP"]).alias("flow"),
            measures.alias("measure"),
        )
        .select("snapshot_ts", "task_name", "flow", "measure.value", "measure.type")
        .where(F.col("value") >= reached)
    )
    daily = with_snapshot_times(event_packets(spark, sf_dir), "ts", DAY, PERIOD, ORIGIN)
    spreads = (
        daily.groupBy("snapshot_ts", F.col("src_ip").alias("flow"))
        .agg(F.count_distinct("dst_ip").alias("value"))
        .select(
            "snapshot_ts",
            F.lit(SPREADERS.name).alias("task_name"),
            "flow",
            "value",
            F.lit(SPREAD).alias("type"),
        )
    )
    return hitters.unionByName(spreads)


def true_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_ts, flow, spread): destinations of a source so far, where it has packets.

    A destination counts from the first snapshot of the period that covers it, so the spread
    is a running sum over the snapshots of a period.
    """
    timed = with_snapshot_times(event_packets(spark, sf_dir), "ts", DAY, PERIOD, ORIGIN)
    fresh = (
        timed.groupBy("period_start", "src_ip", "dst_ip")
        .agg(F.min("snapshot_ts").alias("snapshot_ts"))
        .groupBy("period_start", "src_ip", "snapshot_ts")
        .agg(F.count(F.lit(1)).alias("fresh"))
    )
    seen = timed.select("period_start", "src_ip", "snapshot_ts").distinct()
    so_far = (
        W.partitionBy("period_start", "src_ip")
        .orderBy("snapshot_ts")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return seen.join(fresh, ["period_start", "src_ip", "snapshot_ts"], "left").select(
        "snapshot_ts", F.col("src_ip").alias("flow"), F.sum("fresh").over(so_far).alias("spread")
    )


# The same tables as common table expressions after `p`.
TICKS = (
    "t AS (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS snapshot_ts, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(floor(date_diff('day', DATE '2024-01-01', "
    "CAST(ts AS DATE)) / 10) * 10 AS INTEGER)) AS period_start FROM p)"
)
KEY_SQL_TYPES = ("VARCHAR", "VARCHAR", "INTEGER", "INTEGER", "INTEGER")


def padded(keys: list[str]) -> str:
    """The five keys, NULL where a task does not use them."""
    return ", ".join(
        f"{name}" if name in keys else f"CAST(NULL AS {kind}) AS {name}"
        for name, kind in zip(KEYS, KEY_SQL_TYPES)
    )


def snapshots_sql(task: ExactTask) -> str:
    keys = ", ".join(task.keys)
    return f"""SELECT snapshot_ts, '{task.name}' AS task_name, {padded(task.keys)},
 min(s) OVER w AS start_time, max(e) OVER w AS end_time,
 CAST(sum(b) OVER w AS BIGINT) AS byte_count, CAST(sum(n) OVER w AS BIGINT) AS packet_count,
 period_start
 FROM (SELECT period_start, snapshot_ts, {keys}, min(ts) AS s, max(ts) AS e,
       sum(length) AS b, count(*) AS n FROM t GROUP BY period_start, snapshot_ts, {keys})
 WINDOW w AS (PARTITION BY period_start, {keys} ORDER BY snapshot_ts
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


FM = f"WITH {EVENTS}, {TICKS}, fm AS ({' UNION ALL '.join(snapshots_sql(t) for t in EXACT)})"
HH = f"""{FM}, hh AS (
 SELECT snapshot_ts, 'votes_by_source' AS task_name, src_ip AS flow, packet_count AS value, 0 AS type
   FROM fm WHERE task_name = 'per_src_ip' AND packet_count >= {REPORT_COUNT}
 UNION ALL SELECT snapshot_ts, 'votes_by_source', src_ip, byte_count, 1
   FROM fm WHERE task_name = 'per_src_ip' AND byte_count >= {REPORT_SIZE}
 UNION ALL SELECT snapshot_ts, 'spread_by_source', src_ip, count(DISTINCT dst_ip), 2
   FROM t GROUP BY snapshot_ts, src_ip)"""
LATEST = (
    "latest AS (SELECT * FROM fm QUALIFY row_number() OVER (PARTITION BY task_name, src_ip, "
    "dst_ip, src_port, dst_port, protocol ORDER BY snapshot_ts DESC, byte_count DESC) = 1)"
)
