"""Streaming jobs over the events table, drained and read back."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.model import rules_frame
from flowloom.operators.snapshots import latest_per_flow
from flowloom.session import shared_dir
from flowloom.sinks.tables import heavy_hitters_scan, write_heavy_hitters
from flowloom.sources.packets import packets_scan, packets_stream
from flowloom.streaming.flows import (
    stream_alerts,
    stream_archive,
    stream_close,
    stream_hitters,
    stream_snapshots,
    stream_spread,
    stream_tasks,
    streamed_hitters,
    streamed_snapshots,
    streamed_spreads,
)
from registered.catalog import query
from registered.presets import (
    EXACT,
    FIRES_SQL,
    FM,
    HH,
    RULES,
    RULES_SQL,
    SPREADERS,
    TICKS,
    VOTE,
    heavy_hitters,
    true_spreads,
)
from registered.views import (
    DAY,
    EVENTS,
    FIVE,
    ORIGIN,
    PERIOD,
    event_packets,
    event_packets_stream,
)

P = f"WITH {EVENTS}"
LONG = timedelta(days=400)
MEASURES = (
    "min(ts) AS start_time, max(ts) AS end_time, CAST(sum(length) AS BIGINT) AS byte_count, "
    "count(*) AS packet_count"
)


def _drained(spark, packets, tasks, period, start=stream_snapshots, lateness=LONG):
    """A streamed table of the tasks over all packets."""
    path, checkpoint = shared_dir(spark, "stream"), shared_dir(spark, "checkpoint")
    stream_close(
        start, packets, tasks, DAY, period, path, checkpoint, origin=ORIGIN, lateness=lateness
    )
    return path


# Packets of a file of an arrival, about; a task reads one such file.
ARRIVAL_ROWS = 250_000


def _arrivals(spark, sf_dir):
    """The packets as files of three arrivals, each with some packets of every day.

    An arrival has files in proportion to its packets, so that more tasks read more of them.
    """
    folder, packets = shared_dir(spark, "arrivals"), event_packets(spark, sf_dir)
    files = max(1, -(-packets.count() // (3 * ARRIVAL_ROWS)))
    packets.repartition(3 * files, "event_id").write.parquet(folder)
    return packets_stream(spark, folder, maxFilesPerTrigger=files)


def closing(rows, keys):
    """The last snapshot of every flow and period."""
    last = W.partitionBy("period_start", *keys).orderBy(F.desc("snapshot_ts"))
    newest = rows.withColumn("place", F.row_number().over(last)).where("place = 1")
    return newest.select(
        "period_start", *keys, "start_time", "end_time", "byte_count", "packet_count"
    )


@query(
    "stream_flows",
    f"""WITH {EVENTS}, {TICKS} SELECT period_start, {FIVE}, {MEASURES} FROM t
 GROUP BY period_start, {FIVE}""",
)
def _(spark, sf_dir):
    path = _drained(spark, event_packets_stream(spark, sf_dir), EXACT[0], PERIOD)
    return closing(streamed_snapshots(spark, path), FIVE.split(", "))


# Every snapshot, not only the last one: all days arrive in one batch.
@query("stream_snapshots", f"{FM} SELECT * FROM fm")
def _(spark, sf_dir):
    path = _drained(spark, event_packets_stream(spark, sf_dir), EXACT, PERIOD)
    return streamed_snapshots(spark, path)


# The same in three batches, of which the later ones correct the snapshots before.
@query("stream_snapshots_late", f"{FM} SELECT * FROM fm WHERE task_name = 'per_src_ip'")
def _(spark, sf_dir):
    path = _drained(spark, _arrivals(spark, sf_dir), EXACT[1], PERIOD)
    return streamed_snapshots(spark, path)


@query(
    "stream_close",
    f"""WITH {EVENTS}, {TICKS} SELECT count(*) AS flows, CAST(sum(b) AS BIGINT) AS total_bytes,
 CAST(sum(n) AS BIGINT) AS total_packets FROM (SELECT count(*) AS n, sum(length) AS b FROM t
 GROUP BY period_start, dst_ip)""",
)
def _(spark, sf_dir):
    path = _drained(spark, event_packets_stream(spark, sf_dir), EXACT[2], PERIOD)
    return closing(streamed_snapshots(spark, path), ["dst_ip"]).agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum("byte_count").alias("total_bytes"),
        F.sum("packet_count").alias("total_packets"),
    )


@query(
    "late_data",
    f"""{P} SELECT date_trunc('day', ts) AS period_start, src_ip, {MEASURES} FROM p
 WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    # The first days arrive after the watermark has passed them and are dropped.
    packets = event_packets(spark, sf_dir)
    folder, path = shared_dir(spark, "arrivals"), shared_dir(spark, "stream")
    checkpoint = shared_dir(spark, "checkpoint")
    on_time = F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")
    for arrived in (packets.where(on_time), packets.where(~on_time)):
        arrived.write.mode("append").parquet(folder)
        stream_close(
            stream_snapshots, packets_stream(spark, folder), EXACT[1], DAY, DAY, path, checkpoint,
            origin=ORIGIN, lateness=DAY,
        )
    return closing(streamed_snapshots(spark, path), ["src_ip"])


HITS = f"""SELECT snapshot_ts, '{VOTE.name}' AS task_name, src_ip AS flow, packet_count AS value, 0 AS type
   FROM fm WHERE task_name = 'per_src_ip' AND packet_count >= {VOTE.count_threshold}
 UNION ALL SELECT snapshot_ts, '{VOTE.name}', src_ip, byte_count, 1
   FROM fm WHERE task_name = 'per_src_ip' AND byte_count >= {VOTE.size_threshold}"""
LOW = replace(VOTE, count_threshold=20, size_threshold=2000)
LOW_HITS = HITS.replace(f">= {VOTE.count_threshold}", ">= 20").replace(
    f">= {VOTE.size_threshold}", ">= 2000"
)


@query(
    "stream_tasks",
    f"""{FM}, hits AS ({LOW_HITS})
 SELECT task_name, count(*) AS row_count, count(DISTINCT snapshot_ts) AS snapshots FROM fm
  GROUP BY task_name
 UNION ALL SELECT task_name, count(*), count(DISTINCT snapshot_ts) FROM hits GROUP BY task_name
 UNION ALL SELECT '{SPREADERS.name}', count(DISTINCT (snapshot_ts, src_ip)), count(DISTINCT snapshot_ts) FROM t""",
)
def _(spark, sf_dir):
    base = shared_dir(spark, "tasks")
    spreads = replace(SPREADERS, count_threshold=1)
    started = stream_tasks(
        event_packets_stream(spark, sf_dir), EXACT, [LOW, spreads], DAY, PERIOD, base,
        origin=ORIGIN, lateness=LONG,
    )
    for running in started:
        running.awaitTermination()
    tables = [
        streamed_snapshots(spark, f"{base}/flow_metrics").where(F.col("task_name") != LOW.name),
        streamed_hitters(spark, f"{base}/flow_metrics", LOW),
        streamed_spreads(spark, f"{base}/spreads", spreads),
    ]
    rows = [table.select("task_name", "snapshot_ts") for table in tables]
    return (
        rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("task_name").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct("snapshot_ts").alias("snapshots"),
        )
    )


@query("stream_hitters", f"{FM} {HITS}")
def _(spark, sf_dir):
    path = _drained(spark, _arrivals(spark, sf_dir), VOTE, PERIOD, stream_hitters)
    return streamed_hitters(spark, path, VOTE)


@query(
    "stream_hitters_as_of",
    f"""{FM}, hits AS ({LOW_HITS}) SELECT task_name, flow, value, type FROM hits
 WHERE snapshot_ts = TIMESTAMP '2024-01-06 00:00:00'""",
)
def _(spark, sf_dir):
    path = _drained(spark, _arrivals(spark, sf_dir), LOW, PERIOD, stream_hitters)
    at = F.lit("2024-01-06").cast("timestamp_ntz")
    rows = streamed_hitters(spark, path, LOW).where(F.col("snapshot_ts") == at)
    return rows.select("task_name", "flow", "value", "type")


# 4096 registers keep the estimates of this table within 8 percent; the spread of small
# flows is exact.
@query(
    "stream_spread",
    f"""WITH {EVENTS}, {TICKS}, seen AS (SELECT DISTINCT period_start, snapshot_ts, src_ip FROM t)
 SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS far_off FROM seen""",
)
def _(spark, sf_dir):
    task = replace(SPREADERS, count_threshold=1, m=4096)
    path = _drained(spark, _arrivals(spark, sf_dir), task, PERIOD, stream_spread)
    rows = streamed_spreads(spark, path, task)
    truth = true_spreads(spark, sf_dir)
    off = F.abs(F.col("value") - F.col("spread")) / F.col("spread")
    return rows.join(truth, ["snapshot_ts", "flow"]).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(off > 0.08).alias("far_off")
    )


@query(
    "stream_alerts",
    f"""{HH}, {RULES_SQL}, cur AS (SELECT max(ts) AS checked, max(period_start) AS began FROM t),
 newest AS (SELECT fm.* FROM fm, cur WHERE period_start = began AND snapshot_ts <= checked
   QUALIFY row_number() OVER (PARTITION BY task_name, {FIVE} ORDER BY snapshot_ts DESC) = 1),
 tot AS (SELECT task_name, count(*) AS f, sum(byte_count) AS b, sum(packet_count) AS n FROM newest GROUP BY task_name),
 totals AS (SELECT task_name, 'total_flows' AS metric, CAST(f AS BIGINT) AS value FROM tot
  UNION ALL SELECT task_name, 'total_bytes', CAST(b AS BIGINT) FROM tot
  UNION ALL SELECT task_name, 'total_packets', CAST(n AS BIGINT) FROM tot),
 hit AS (SELECT hh.* FROM hh, cur WHERE snapshot_ts > began AND snapshot_ts <= checked
   QUALIFY row_number() OVER (PARTITION BY task_name, type, flow ORDER BY snapshot_ts DESC) = 1)
 SELECT r.rule_name, r.task_name, CAST(NULL AS VARCHAR) AS flow, v.value FROM totals v JOIN rules r
   ON r.task_name = v.task_name AND r.metric = v.metric WHERE {FIRES_SQL}
 UNION ALL SELECT r.rule_name, r.task_name, v.flow, v.value FROM hit v JOIN rules r ON r.task_name = v.task_name
   AND ((r.metric = 'heavy_hitter_count' AND v.type IN (0, 2)) OR (r.metric = 'heavy_hitter_size' AND v.type = 1)
     OR (r.metric = 'super_spreader_spread' AND v.type = 2)) WHERE {FIRES_SQL}""",
)
def _(spark, sf_dir):
    # Totals from a streamed table, hitters from a stored one.
    packets = event_packets_stream(spark, sf_dir)
    flows, hitters = _drained(spark, packets, EXACT, PERIOD), shared_dir(spark, "heavy-hitters")
    write_heavy_hitters(heavy_hitters(spark, sf_dir), hitters)
    path = shared_dir(spark, "alerts")
    stream_close(
        stream_alerts, packets, rules_frame(spark, RULES),
        lambda: streamed_snapshots(spark, flows), lambda: heavy_hitters_scan(spark, hitters),
        path, shared_dir(spark, "checkpoint"), period=PERIOD, origin=ORIGIN,
    )
    lines = spark.read.parquet(path).where("line_no = 1")
    return lines.select("rule_name", "task_name", "flow", "value")


@query("stream_archive", f"{P} SELECT * FROM p")
def _(spark, sf_dir):
    path, checkpoint = shared_dir(spark, "archive"), shared_dir(spark, "checkpoint")
    stream_close(stream_archive, event_packets_stream(spark, sf_dir), path, checkpoint)
    return packets_scan(spark, path)


@query("packets_stream", f"{P} SELECT src_ip, CAST(sum(length) AS BIGINT) AS byte_count FROM p GROUP BY src_ip")
def _(spark, sf_dir):
    # Files written by one job, read as a stream by another.
    path = _drained(spark, _arrivals(spark, sf_dir), EXACT[1], LONG)
    return latest_per_flow(streamed_snapshots(spark, path)).select("src_ip", "byte_count")
