"""Exact aggregation, snapshots, questions, lookups and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.model import FIVE_TUPLE, ExactTask
from flowloom.operators.flows import (
    exact_heavy_hitters,
    exact_spread,
    flow_aggregate,
    multi_task_aggregate,
    snapshot_totals,
    top_n,
)
from flowloom.operators.lookups import drill_down, flow_lookup
from flowloom.operators.ranking import ranked, sorted_hitters, top_k
from flowloom.operators.snapshots import cumulative_snapshots, latest_per_flow
from flowloom.plans.questions import (
    aggregate_flows,
    latest_hitters,
    latest_super_spreaders,
    list_tasks,
    timeseries_points,
    trace_flow,
    trace_requests,
)
from registered.catalog import query
from registered.presets import (
    EXACT,
    FM,
    HH,
    LATEST,
    TICKS,
    flow_metrics,
    heavy_hitters,
    padded,
    snapshots_sql,
    task_metrics,
)
from registered.views import (
    DAY,
    EVENTS,
    FIVE,
    LINEITEM,
    ORIGIN,
    PERIOD,
    event_packets,
    lineitem_packets,
)

P = f"WITH {EVENTS}"
MEASURES = (
    "min(ts) AS start_time, max(ts) AS end_time, CAST(sum(length) AS BIGINT) AS byte_count, "
    "count(*) AS packet_count"
)


@query("flow_aggregate", f"{P} SELECT {FIVE}, {MEASURES} FROM p GROUP BY {FIVE}")
def _(spark, sf_dir):
    return flow_aggregate(event_packets(spark, sf_dir), FIVE_TUPLE)


@query(
    "flow_aggregate_lineitem", f"WITH {LINEITEM} SELECT {FIVE}, {MEASURES} FROM p GROUP BY {FIVE}"
)
def _(spark, sf_dir):
    return flow_aggregate(lineitem_packets(spark, sf_dir), FIVE_TUPLE)


@query("flow_aggregate_src", f"WITH {LINEITEM} SELECT src_ip, {MEASURES} FROM p GROUP BY src_ip")
def _(spark, sf_dir):
    return flow_aggregate(lineitem_packets(spark, sf_dir), ["SrcIP"])


TASKS = [*EXACT, ExactTask("per_source", ["SrcIP"]), ExactTask("per_service", ["Protocol", "DstPort"])]
MORE_TASKS = [
    *TASKS,
    ExactTask("per_pair", ["SrcIP", "DstIP"]),
    ExactTask("per_protocol", ["Protocol"]),
]


def tasks_sql(tasks) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t.name}' AS task_name, {padded(t.keys)}, {MEASURES} FROM p "
        f"GROUP BY {', '.join(t.keys)}"
        for t in tasks
    )


@query("multi_task_aggregate", f"{P} {tasks_sql(TASKS)}")
def _(spark, sf_dir):
    return multi_task_aggregate(event_packets(spark, sf_dir), TASKS)


@query("multi_task_roll_up", f"{P} {tasks_sql(MORE_TASKS)}")
def _(spark, sf_dir):
    return multi_task_aggregate(event_packets(spark, sf_dir), MORE_TASKS)


@query(
    "snapshot_totals",
    f"""{P} SELECT task_name, count(*) AS total_flows, CAST(sum(byte_count) AS BIGINT) AS total_bytes,
 CAST(sum(packet_count) AS BIGINT) AS total_packets FROM ({tasks_sql(EXACT)}) GROUP BY task_name""",
)
def _(spark, sf_dir):
    return snapshot_totals(multi_task_aggregate(event_packets(spark, sf_dir), EXACT))


@query("cumulative_snapshots", f"WITH {EVENTS}, {TICKS} {snapshots_sql(EXACT[1])}")
def _(spark, sf_dir):
    return task_metrics(spark, sf_dir, EXACT[1])


DENSE = f"""WITH {EVENTS}, {TICKS},
 ticks AS (SELECT DISTINCT period_start, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d AS INTEGER)) AS snapshot_ts
   FROM range(1, 400) r(d), (SELECT DISTINCT period_start FROM t)
   WHERE TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d AS INTEGER)) > period_start
     AND TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d AS INTEGER)) <= period_start + INTERVAL 10 DAY
     AND TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d AS INTEGER)) <= (SELECT max(snapshot_ts) FROM t))
 SELECT k.snapshot_ts, 'per_src_ip' AS task_name, t.src_ip, CAST(NULL AS VARCHAR) AS dst_ip,
 CAST(NULL AS INTEGER) AS src_port, CAST(NULL AS INTEGER) AS dst_port, CAST(NULL AS INTEGER) AS protocol,
 {MEASURES}, k.period_start
 FROM t JOIN ticks k ON t.period_start = k.period_start AND t.ts < k.snapshot_ts
 GROUP BY k.snapshot_ts, k.period_start, t.src_ip"""


@query("cumulative_snapshots_dense", DENSE)
def _(spark, sf_dir):
    return cumulative_snapshots(
        event_packets(spark, sf_dir), EXACT[1], DAY, PERIOD, ORIGIN, dense=True
    )


@query(
    "latest_per_flow",
    f"""{FM}, {LATEST} SELECT task_name, {FIVE}, snapshot_ts, byte_count, packet_count, start_time,
 end_time, period_start FROM latest""",
)
def _(spark, sf_dir):
    return latest_per_flow(flow_metrics(spark, sf_dir))


def totals_sql(where: str) -> str:
    latest = LATEST.replace("SELECT * FROM fm", f"SELECT * FROM fm WHERE {where}")
    return f"""{FM}, {latest} SELECT task_name, CAST(sum(byte_count) AS BIGINT) AS total_bytes,
 CAST(sum(packet_count) AS BIGINT) AS total_packets, count(*) AS flow_count
 FROM latest GROUP BY task_name"""


END = "2024-01-18 00:00:00"


@query("aggregate_flows", totals_sql(f"snapshot_ts <= TIMESTAMP '{END}'"))
def _(spark, sf_dir):
    return aggregate_flows(flow_metrics(spark, sf_dir), END)


@query(
    "aggregate_flows_filtered",
    totals_sql(
        f"snapshot_ts <= TIMESTAMP '{END}' AND task_name = 'flows_by_tuple' AND protocol = 6 "
        "AND dst_port = 443"
    ),
)
def _(spark, sf_dir):
    return aggregate_flows(
        flow_metrics(spark, sf_dir), END, task="flows_by_tuple", dst_port=443, protocol=6
    )


@query(
    "aggregate_flows_period",
    totals_sql("period_start = TIMESTAMP '2024-01-11 00:00:00'"),
)
def _(spark, sf_dir):
    return aggregate_flows(flow_metrics(spark, sf_dir), period_start="2024-01-11 00:00:00")


def trace_sql(where: str) -> str:
    return f"""{FM} SELECT coalesce(min(start_time), TIMESTAMP '1970-01-01 00:00:00') AS first_seen,
 coalesce(max(end_time), TIMESTAMP '1970-01-01 00:00:00') AS last_seen,
 coalesce(max(packet_count), 0) AS total_packets, coalesce(max(byte_count), 0) AS total_bytes
 FROM fm WHERE {where}"""


@query(
    "trace_flow",
    trace_sql(
        "task_name = 'flows_by_tuple' AND src_ip = '10.0.0.7' AND dst_port = 443 "
        f"AND snapshot_ts <= TIMESTAMP '{END}'"
    ),
)
def _(spark, sf_dir):
    keys = {"SrcIP": "10.0.0.7", "DstPort": "443"}
    return trace_flow(flow_metrics(spark, sf_dir), "flows_by_tuple", keys, END)


@query("trace_flow_unmatched", trace_sql("task_name = 'per_src_ip' AND src_ip = '203.0.113.1'"))
def _(spark, sf_dir):
    return trace_flow(flow_metrics(spark, sf_dir), "per_src_ip", {"SrcIP": "203.0.113.1"})


# A request per event: its own source, service, destination, five-tuple, or nothing.
REQUEST_KEYS = """CASE WHEN protocol = 1 THEN 'SrcIP=203.0.113.1'
 WHEN dst_port = 80 THEN concat('SrcIP=', src_ip)
 WHEN dst_port = 443 THEN concat(' SrcIP = ', src_ip, ',DstPort=443')
 WHEN dst_port = 8443 THEN concat('Protocol=6, DstIP=', dst_ip)
 ELSE concat('SrcIP=', src_ip, ',DstIP=', dst_ip, ',SrcPort=', CAST(src_port AS VARCHAR(9)),
   ',DstPort=', CAST(dst_port AS VARCHAR(9)), ',Protocol=', CAST(protocol AS VARCHAR(9))) END"""
REQUEST_MATCHES = {
    "p.protocol = 1": "f.src_ip = '203.0.113.1'",
    "p.dst_port = 80": "f.src_ip = p.src_ip",
    "p.dst_port = 443": "f.src_ip = p.src_ip AND f.dst_port = 443",
    "p.dst_port = 8443": "f.dst_ip = p.dst_ip AND f.protocol = 6",
    "p.dst_port = 53": "f.src_ip = p.src_ip AND f.dst_ip = p.dst_ip AND f.src_port = p.src_port "
    "AND f.dst_port = p.dst_port AND f.protocol = p.protocol",
}
TRACES = " UNION ALL ".join(
    f"""SELECT p.event_id AS request_id,
 coalesce(min(f.start_time), TIMESTAMP '1970-01-01 00:00:00') AS first_seen,
 coalesce(max(f.end_time), TIMESTAMP '1970-01-01 00:00:00') AS last_seen,
 coalesce(max(f.packet_count), 0) AS total_packets, coalesce(max(f.byte_count), 0) AS total_bytes
 FROM p LEFT JOIN fm f ON f.task_name = 'flows_by_tuple' AND {match}
  AND f.snapshot_ts <= p.ts + INTERVAL 3 DAY
 WHERE {which} GROUP BY p.event_id"""
    for which, match in REQUEST_MATCHES.items()
)


@query("trace_requests", f"{FM} {TRACES}")
def _(spark, sf_dir):
    requests = event_packets(spark, sf_dir).selectExpr(
        "event_id AS request_id",
        "'flows_by_tuple' AS task_name",
        f"{REQUEST_KEYS} AS flow_keys",
        "ts + INTERVAL 3 DAYS AS end_time",
    )
    return trace_requests(task_metrics(spark, sf_dir, EXACT[0]), requests)


@query(
    "exact_heavy_hitters",
    f"""{P} SELECT src_ip AS flow, count(*) AS value, 0 AS type FROM p GROUP BY src_ip
 HAVING count(*) >= 75 UNION ALL SELECT src_ip, CAST(sum(length) AS BIGINT), 1 FROM p
 GROUP BY src_ip HAVING sum(length) >= 7500""",
)
def _(spark, sf_dir):
    packets = event_packets(spark, sf_dir)
    by_count = exact_heavy_hitters(packets, ["SrcIP"], "packets", 75)
    return by_count.unionByName(exact_heavy_hitters(packets, ["SrcIP"], "bytes", 7500))


@query(
    "top_n",
    f"""WITH {LINEITEM} SELECT src_ip, CAST(sum(length) AS BIGINT) AS value FROM p GROUP BY src_ip
 ORDER BY value DESC, src_ip LIMIT 10""",
)
def _(spark, sf_dir):
    return top_n(lineitem_packets(spark, sf_dir), "SrcIP", 10, "bytes")


@query(
    "top_n_ports",
    f"""{P} SELECT dst_port, count(*) AS value FROM p GROUP BY dst_port
 ORDER BY value DESC, dst_port LIMIT 3""",
)
def _(spark, sf_dir):
    return top_n(event_packets(spark, sf_dir), "DstPort", 3, "packets")


@query(
    "exact_spread",
    f"""WITH {LINEITEM} SELECT src_ip AS flow, count(DISTINCT dst_ip) AS spread FROM p
 GROUP BY src_ip""",
)
def _(spark, sf_dir):
    return exact_spread(lineitem_packets(spark, sf_dir), ["SrcIP"], ["DstIP"])


@query(
    "exact_spread_fields",
    f"""{P} SELECT src_ip AS flow, count(DISTINCT (dst_ip, dst_port, protocol)) AS spread FROM p
 GROUP BY src_ip""",
)
def _(spark, sf_dir):
    elements = ["DstIP", "DstPort", "Protocol"]
    return exact_spread(event_packets(spark, sf_dir), ["SrcIP"], elements)


@query(
    "list_tasks",
    f"""{HH} SELECT DISTINCT task_name, 'exact' AS source FROM fm
 UNION ALL SELECT DISTINCT task_name, 'sketch' FROM hh""",
)
def _(spark, sf_dir):
    return list_tasks(flow_metrics(spark, sf_dir), heavy_hitters(spark, sf_dir))


TARGETS = ["per_src_ip", "no_such_task", "flows_by_tuple"]


@query(
    "timeseries_points",
    f"""{FM}, {LATEST.replace('FROM fm', f"FROM fm WHERE snapshot_ts <= TIMESTAMP '{END}'")}
 SELECT g.target, CAST(coalesce(sum(l.packet_count), 0) AS BIGINT) AS total_packets,
 epoch_ms(TIMESTAMP '{END}') AS end_ms
 FROM (VALUES {', '.join(f"('{t}')" for t in TARGETS)}) g(target)
 LEFT JOIN latest l ON l.task_name = g.target GROUP BY g.target""",
)
def _(spark, sf_dir):
    return timeseries_points(flow_metrics(spark, sf_dir), TARGETS, END)


def hitters_sql(task: str, code: int, end: str | None, limit: int) -> str:
    bound = f" AND snapshot_ts <= TIMESTAMP '{end}'" if end else ""
    return f"""{HH} SELECT flow, value FROM (SELECT flow, value FROM hh
 WHERE task_name = '{task}' AND type = {code}{bound}
 QUALIFY row_number() OVER (PARTITION BY flow ORDER BY snapshot_ts DESC, value DESC) = 1)
 ORDER BY value DESC, flow LIMIT {limit}"""


@query("latest_hitters", hitters_sql("votes_by_source", 1, END, 10))
def _(spark, sf_dir):
    return latest_hitters(heavy_hitters(spark, sf_dir), "votes_by_source", 1, 10, END)


@query("latest_super_spreaders", hitters_sql("spread_by_source", 2, None, 20))
def _(spark, sf_dir):
    return latest_super_spreaders(heavy_hitters(spark, sf_dir), "spread_by_source", 20)


BY_SOURCE = f"{P}, h AS (SELECT src_ip AS flow, CAST(sum(length) AS BIGINT) AS value FROM p GROUP BY src_ip)"


def _by_source(spark, sf_dir):
    return exact_heavy_hitters(event_packets(spark, sf_dir), ["SrcIP"], "bytes", 0).drop("type")


@query("top_k", f"{BY_SOURCE} SELECT * FROM h ORDER BY value DESC, flow LIMIT 10")
def _(spark, sf_dir):
    return top_k(_by_source(spark, sf_dir), 10)


@query(
    "ranked",
    f"""{BY_SOURCE} SELECT flow, value, CAST(row_number() OVER (ORDER BY value DESC, flow) AS INTEGER)
 AS "rank" FROM h ORDER BY value DESC, flow LIMIT 10""",
)
def _(spark, sf_dir):
    return ranked(_by_source(spark, sf_dir), 10)


@query("sorted_hitters", f"{BY_SOURCE} SELECT * FROM h ORDER BY value DESC, flow")
def _(spark, sf_dir):
    return sorted_hitters(_by_source(spark, sf_dir))


@query(
    "flow_lookup",
    f"""{P}, f AS (SELECT src_ip, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count
 FROM p GROUP BY src_ip), w AS (SELECT event_id, src_ip FROM p UNION ALL SELECT event_id, dst_ip FROM p)
 SELECT w.event_id, w.src_ip, coalesce(f.packet_count, 0) AS packet_count,
 coalesce(f.byte_count, 0) AS byte_count FROM w LEFT JOIN f ON w.src_ip = f.src_ip""",
)
def _(spark, sf_dir):
    # Both ends of every packet are looked up; targets send nothing and get 0.
    packets = event_packets(spark, sf_dir)
    targets = packets.select("event_id", F.col("dst_ip").alias("src_ip"))
    wanted = packets.select("event_id", "src_ip").unionByName(targets)
    return flow_lookup(flow_aggregate(packets, ["SrcIP"]), wanted, ["SrcIP"])


@query(
    "drill_down",
    f"""{FM} SELECT src_ip AS flow, snapshot_ts, packet_count, byte_count FROM fm
 WHERE task_name = 'per_src_ip' AND src_ip IN
 (SELECT src_ip FROM p GROUP BY src_ip HAVING count(*) >= 75)""",
)
def _(spark, sf_dir):
    hitters = exact_heavy_hitters(event_packets(spark, sf_dir), ["SrcIP"], "packets", 75)
    rows = drill_down(hitters, flow_metrics(spark, sf_dir), EXACT[1])
    return rows.select("flow", "snapshot_ts", "packet_count", "byte_count")
