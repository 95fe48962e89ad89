"""Column expressions, filters and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions.addresses import normalize_ips
from flowloom.functions.checks import check
from flowloom.functions.hashing import seeded_buckets
from flowloom.functions.keys import flow_key, flow_label, l4_ports, pad_missing_keys, project_key
from flowloom.functions.times import (
    flow_duration,
    nanos_to_ts,
    packet_line,
    parse_snapshot_label,
    snapshot_label,
    ts_to_nanos,
)
from flowloom.model import FIVE_TUPLE
from flowloom.operators.filters import (
    as_of,
    filter_flow_keys,
    filter_flows,
    filter_hitters,
    filter_ip,
)
from flowloom.operators.flows import flow_aggregate
from registered.catalog import query
from registered.presets import FM, HH, flow_metrics, heavy_hitters, padded
from registered.views import EVENTS, FIVE, LINEITEM, event_packets, events, lineitem_packets

P = f"WITH {EVENTS}"


@query("project_key", f"{P} SELECT dst_ip, protocol, dst_port FROM p")
def _(spark, sf_dir):
    return project_key(event_packets(spark, sf_dir), ["DstIP", "Protocol", "DstPort"])


@query("flow_key", f"{P} SELECT event_id, concat_ws('-', {FIVE}) AS flow_key FROM p")
def _(spark, sf_dir):
    return event_packets(spark, sf_dir).select("event_id", flow_key(FIVE_TUPLE).alias("flow_key"))


@query("flow_label", f"{P} SELECT event_id, concat_ws(' ', src_ip, dst_port) AS flow FROM p")
def _(spark, sf_dir):
    labels = flow_label(["SrcIP", "DstPort"]).alias("flow")
    return event_packets(spark, sf_dir).select("event_id", labels)


# Addresses in several spellings, made from the user and event type.
SPELLINGS = """CASE event_type
 WHEN 'click' THEN concat('010.000.', CAST(user_id % 200 AS INT), '.07')
 WHEN 'view' THEN concat('::ffff:10.0.0.', CAST(user_id % 256 AS INT))
 WHEN 'purchase' THEN concat('2001:0DB8:0:0:0:00:0000:', CAST(user_id % 9 + 1 AS INT))
 WHEN 'error' THEN concat('2001:db8:0:0:1:0:0:', CAST(user_id % 9 + 1 AS INT))
 ELSE concat('not an address ', CAST(user_id AS INT)) END"""
CANONICAL = """CASE event_type
 WHEN 'click' THEN concat('10.0.', CAST(user_id % 200 AS INT), '.7')
 WHEN 'view' THEN concat('10.0.0.', CAST(user_id % 256 AS INT))
 WHEN 'purchase' THEN concat('2001:db8::', CAST(user_id % 9 + 1 AS INT))
 WHEN 'error' THEN concat('2001:db8::1:0:0:', CAST(user_id % 9 + 1 AS INT)) END"""


@query("normalize_ips", f"SELECT event_id, {CANONICAL} AS src_ip FROM events")
def _(spark, sf_dir):
    spelled = events(spark, sf_dir).selectExpr("event_id", f"{SPELLINGS} AS src_ip")
    return normalize_ips(spelled, ["src_ip"])


@query(
    "l4_ports",
    f"""{P} SELECT event_id, protocol,
 CASE WHEN protocol IN (6, 17) THEN src_port + 1 ELSE 0 END AS src_port,
 CASE WHEN protocol IN (6, 17) THEN dst_port ELSE 0 END AS dst_port FROM p""",
)
def _(spark, sf_dir):
    # The given packets of other protocols have no ports; one up, every packet has.
    packets = event_packets(spark, sf_dir).withColumn("src_port", F.col("src_port") + 1)
    return l4_ports(packets).select("event_id", "protocol", "src_port", "dst_port")


@query("ts_to_nanos", f"{P} SELECT event_id, epoch_us(ts) * 1000 AS nanos FROM p")
def _(spark, sf_dir):
    return event_packets(spark, sf_dir).select("event_id", ts_to_nanos(F.col("ts")).alias("nanos"))


@query("nanos_to_ts", f"{P} SELECT event_id, ts FROM p")
def _(spark, sf_dir):
    # The 789 nanoseconds below the microsecond are rounded away.
    nanos = ts_to_nanos(F.col("ts")) + 789
    return event_packets(spark, sf_dir).select(
        "event_id", nanos_to_ts(nanos).cast("timestamp_ntz").alias("ts")
    )


@query(
    "snapshot_label",
    f"""{P} SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS label,
 date_trunc('second', ts) AS parsed FROM p""",
)
def _(spark, sf_dir):
    labelled = event_packets(spark, sf_dir).select(
        "event_id", snapshot_label(F.col("ts")).alias("label")
    )
    return labelled.withColumn("parsed", parse_snapshot_label(F.col("label")))


LINE_SQL = (
    "concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), ' - ', src_ip, ':', src_port, ' -> ', dst_ip, "
    "':', dst_port, ', Proto: ', protocol, ', Len: ', length)"
)


@query("packet_lines", f"{P} SELECT event_id, {LINE_SQL} AS line FROM p")
def _(spark, sf_dir):
    return event_packets(spark, sf_dir).select("event_id", packet_line().alias("line"))


@query(
    "flow_duration",
    f"""{P} SELECT src_ip, date_diff('microsecond', min(ts), max(ts)) AS duration_us
 FROM p GROUP BY src_ip""",
)
def _(spark, sf_dir):
    flows = flow_aggregate(event_packets(spark, sf_dir), ["SrcIP"])
    duration = flow_duration(F.col("start_time"), F.col("end_time"))
    return flows.select("src_ip", duration.alias("duration_us"))


@query(
    "check",
    f"""{P} SELECT event_id, CASE protocol + dst_port WHEN 86 THEN length > 60
 WHEN 449 THEN length < 60 WHEN 8449 THEN length = 60 WHEN 70 THEN length >= 60
 ELSE false END AS fires FROM p""",
)
def _(spark, sf_dir):
    operator = F.expr(
        "CASE protocol + dst_port WHEN 86 THEN '>' WHEN 449 THEN '<' WHEN 8449 THEN '=' "
        "WHEN 70 THEN '>=' ELSE '!=' END"
    )
    fires = check(F.col("length"), operator, F.lit(60))
    return event_packets(spark, sf_dir).select("event_id", fires.alias("fires"))


def bucket_sql(row: str, key: str, width: int) -> str:
    word = f"('0x' || substr(md5(concat(CAST({row} AS VARCHAR), ':', {key})), 1, 8))"
    return f"CAST(CAST({word} AS BIGINT) % {width} AS INTEGER)"


@query(
    "seeded_buckets",
    f"""{P} SELECT event_id, CAST(r.i AS INTEGER) AS "row", {bucket_sql('r.i', 'src_ip', 256)} AS bucket
 FROM p, range(2) r(i)""",
)
def _(spark, sf_dir):
    places = F.explode(seeded_buckets(F.col("src_ip"), 2, 256, "md5")).alias("place")
    return event_packets(spark, sf_dir).select("event_id", places).select("event_id", "place.*")


@query(
    "pad_missing_keys",
    f"""{P} SELECT {padded(['src_ip', 'dst_port'])}, count(*) AS packet_count
 FROM p GROUP BY src_ip, dst_port""",
)
def _(spark, sf_dir):
    flows = flow_aggregate(event_packets(spark, sf_dir), ["SrcIP", "DstPort"])
    padded_flows = pad_missing_keys(flows, ["SrcIP", "DstPort"])
    return padded_flows.drop("start_time", "end_time", "byte_count")


@query("filter_ip", f"{P} SELECT event_id FROM p WHERE protocol <> 1")
def _(spark, sf_dir):
    version = F.expr("CASE WHEN protocol = 1 THEN 0 WHEN protocol = 17 THEN 6 ELSE 4 END")
    packets = event_packets(spark, sf_dir).withColumn("ip_version", version)
    return filter_ip(packets).select("event_id")


@query(
    "filter_flows",
    f"""{FM} SELECT snapshot_ts, dst_ip, packet_count FROM fm WHERE task_name = 'flows_by_tuple'
 AND src_ip = '10.0.0.7' AND src_port = 0 AND protocol = 1""",
)
def _(spark, sf_dir):
    rows = filter_flows(
        flow_metrics(spark, sf_dir), "flows_by_tuple", src_ip="10.0.0.7", src_port=0, protocol=1
    )
    return rows.select("snapshot_ts", "dst_ip", "packet_count")


@query(
    "filter_flow_keys",
    f"""{FM} SELECT snapshot_ts, dst_ip, packet_count FROM fm
 WHERE src_ip = '10.0.0.1' AND dst_port = 443 AND protocol = 6""",
)
def _(spark, sf_dir):
    keys = {"SrcIP": "10.0.0.1", "Protocol": "6", "DstPort": "443"}
    rows = filter_flow_keys(flow_metrics(spark, sf_dir), keys)
    return rows.select("snapshot_ts", "dst_ip", "packet_count")


@query(
    "as_of",
    f"""{FM} SELECT task_name, snapshot_ts, count(*) AS row_count FROM fm
 WHERE snapshot_ts <= TIMESTAMP '2024-01-18 00:00:00' GROUP BY task_name, snapshot_ts""",
)
def _(spark, sf_dir):
    rows = as_of(flow_metrics(spark, sf_dir), "2024-01-18 00:00:00")
    return rows.groupBy("task_name", "snapshot_ts").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "filter_hitters",
    f"""{HH} SELECT snapshot_ts, flow, value FROM hh
 WHERE task_name = 'votes_by_source' AND type = 1""",
)
def _(spark, sf_dir):
    rows = filter_hitters(heavy_hitters(spark, sf_dir), "votes_by_source", 1)
    return rows.select("snapshot_ts", "flow", "value")


@query(
    "l4_ports_lineitem",
    f"""WITH {LINEITEM} SELECT event_id, src_ip, dst_ip,
 CASE WHEN protocol IN (6, 17) THEN src_port ELSE 0 END AS src_port,
 CASE WHEN protocol IN (6, 17) THEN dst_port ELSE 0 END AS dst_port, length FROM p""",
)
def _(spark, sf_dir):
    columns = ["event_id", "src_ip", "dst_ip", "src_port", "dst_port", "length"]
    return l4_ports(lineitem_packets(spark, sf_dir)).select(*columns)
