"""Rules, alerts, messages and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.model import rules_frame
from flowloom.operators.alerts import (
    alert_digest,
    alert_messages,
    alerts_hitters,
    alerts_spread,
    alerts_totals,
    rules_for_tasks,
)
from flowloom.operators.flows import (
    exact_heavy_hitters,
    exact_spread,
    multi_task_aggregate,
    snapshot_totals,
)
from flowloom.operators.spread import super_spreaders
from registered.aggregates import tasks_sql
from registered.catalog import query
from registered.presets import CHECKED_AT, EXACT, FIRES_SQL, RULES, RULES_SQL
from registered.views import EVENTS, event_packets

TOTALS_SQL = f"""tot AS (SELECT task_name, count(*) AS f, CAST(sum(byte_count) AS BIGINT) AS b,
 CAST(sum(packet_count) AS BIGINT) AS n FROM ({tasks_sql(EXACT)}) GROUP BY task_name),
 totals AS (SELECT task_name, 'total_flows' AS metric, f AS value FROM tot
  UNION ALL SELECT task_name, 'total_bytes', b FROM tot
  UNION ALL SELECT task_name, 'total_packets', n FROM tot)"""
HITTERS_SQL = """hit AS (SELECT 'votes_by_source' AS task_name, src_ip AS flow, count(*) AS value, 0 AS type
  FROM p GROUP BY src_ip HAVING count(*) >= 75
 UNION ALL SELECT 'votes_by_source', src_ip, CAST(sum(length) AS BIGINT), 1 FROM p GROUP BY src_ip
  HAVING sum(length) >= 7500
 UNION ALL SELECT 'spread_by_source', src_ip, count(DISTINCT dst_ip), 2 FROM p GROUP BY src_ip
  HAVING count(DISTINCT dst_ip) >= 50)"""
COLUMNS = f"""TIMESTAMP '{CHECKED_AT}' AS check_ts, r.rule_name, r.task_name, r.metric,
 r.op AS operator, r.threshold"""
ON_TOTALS = f"""SELECT {COLUMNS}, CAST(NULL AS VARCHAR) AS flow, v.value FROM totals v JOIN rules r
 ON r.task_name = v.task_name AND r.metric = v.metric WHERE {FIRES_SQL}"""
ON_HITTERS = f"""SELECT {COLUMNS}, v.flow, v.value FROM hit v JOIN rules r ON r.task_name = v.task_name
 AND ((r.metric = 'heavy_hitter_count' AND v.type IN (0, 2)) OR
      (r.metric = 'heavy_hitter_size' AND v.type = 1)) WHERE {FIRES_SQL}"""
ON_SPREAD = f"""SELECT {COLUMNS}, v.flow, v.value FROM hit v JOIN rules r ON r.task_name = v.task_name
 AND r.metric = 'super_spreader_spread' AND v.type = 2 WHERE {FIRES_SQL}"""
BASE = f"WITH {EVENTS}, {RULES_SQL}, {TOTALS_SQL}, {HITTERS_SQL}"


def _flows(spark, sf_dir):
    return multi_task_aggregate(event_packets(spark, sf_dir), EXACT)


def _hitters(spark, sf_dir):
    packets = event_packets(spark, sf_dir)
    votes = exact_heavy_hitters(packets, ["SrcIP"], "packets", 75).unionByName(
        exact_heavy_hitters(packets, ["SrcIP"], "bytes", 7500)
    )
    spreads = super_spreaders(exact_spread(packets, ["SrcIP"], ["DstIP"]), 50)
    return votes.withColumn("task_name", F.lit("votes_by_source")).unionByName(
        spreads.withColumn("task_name", F.lit("spread_by_source"))
    )


@query(
    "rules_for_tasks",
    f"""{BASE} SELECT r.rule_name, v.task_name, v.metric, v.value FROM totals v JOIN rules r
 ON r.task_name = v.task_name AND r.metric = v.metric WHERE {FIRES_SQL}""",
)
def _(spark, sf_dir):
    names = ["total_flows", "total_bytes", "total_packets"]
    totals = snapshot_totals(_flows(spark, sf_dir)).unpivot("task_name", names, "metric", "value")
    fired = rules_for_tasks(rules_frame(spark, RULES), totals, ["task_name", "metric"])
    return fired.select("rule_name", "task_name", "metric", "value")


@query("alerts_totals", f"{BASE} {ON_TOTALS}")
def _(spark, sf_dir):
    return alerts_totals(_flows(spark, sf_dir), rules_frame(spark, RULES), CHECKED_AT)


@query("alerts_hitters", f"{BASE} {ON_HITTERS}")
def _(spark, sf_dir):
    return alerts_hitters(_hitters(spark, sf_dir), rules_frame(spark, RULES), CHECKED_AT)


@query("alerts_spread", f"{BASE} {ON_SPREAD}")
def _(spark, sf_dir):
    return alerts_spread(_hitters(spark, sf_dir), rules_frame(spark, RULES), CHECKED_AT)


def all_alerts(spark, sf_dir):
    rules = rules_frame(spark, RULES)
    hitters = _hitters(spark, sf_dir)
    return (
        alerts_totals(_flows(spark, sf_dir), rules, CHECKED_AT)
        .unionByName(alerts_hitters(hitters, rules, CHECKED_AT))
        .unionByName(alerts_spread(hitters, rules, CHECKED_AT))
    )


MESSAGES = f"""{BASE}, al AS ({ON_TOTALS} UNION ALL {ON_HITTERS} UNION ALL {ON_SPREAD}),
 msg AS (SELECT check_ts, rule_name, task_name, metric, operator, threshold, 1 AS line_no, value, flow,
  concat(CASE WHEN flow IS NULL THEN 'Observed value: ' ELSE concat('  ', flow, ': ') END, value,
   CASE metric WHEN 'total_packets' THEN ' packets' WHEN 'total_flows' THEN ' flows'
    WHEN 'total_bytes' THEN ' bytes' WHEN 'heavy_hitter_size' THEN ' bytes' ELSE '' END) AS text FROM al
 UNION ALL SELECT check_ts, rule_name, task_name, metric, operator, threshold, 0, count(*), NULL,
  printf('Alert: %s' || chr(10) || 'Task: %s' || chr(10) || 'Metric: %s' || chr(10) ||
    'Condition: %s %.2f' || chr(10), rule_name, task_name, metric, operator, threshold)
  FROM al GROUP BY check_ts, rule_name, task_name, metric, operator, threshold)"""


@query("alert_messages", f"{MESSAGES} SELECT * FROM msg")
def _(spark, sf_dir):
    return alert_messages(all_alerts(spark, sf_dir))


DIGEST = f"""{MESSAGES}, checks AS (SELECT check_ts, CAST(count(DISTINCT task_name) AS INTEGER) AS tasks
 FROM msg GROUP BY check_ts)
 SELECT check_ts, tasks, concat('Alert summary (', tasks, ' triggered)') AS subject, rule_name, task_name,
  metric, operator, threshold, line_no, value, flow, text FROM msg JOIN checks USING (check_ts)"""


@query("alert_digest", DIGEST)
def _(spark, sf_dir):
    return alert_digest(alert_messages(all_alerts(spark, sf_dir)))
