from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowloom.model import AlertRule, rules_frame
from flowloom.operators.alerts import (
    alert_digest,
    alert_messages,
    alerts_hitters,
    alerts_spread,
    alerts_totals,
)
from registered.presets import CHECKED_AT

FLOWS = [("exact", 100, 2), ("exact", 50, 3), ("other", 7, 1)]
HITTERS = [("votes", "a", 90, 0), ("votes", "b", 10, 0), ("votes", "a", 9000, 1), ("spread", "c", 60, 2)]


@pytest.fixture
def flows(spark):
    return spark.createDataFrame(FLOWS, "task_name string, byte_count bigint, packet_count bigint")


@pytest.fixture
def hitters(spark):
    return spark.createDataFrame(HITTERS, "task_name string, flow string, value bigint, type int")


def fired(alerts):
    return sorted((row.rule_name, row.flow, row.value) for row in alerts.collect())


def test_totals(spark, flows):
    rules = rules_frame(
        spark,
        [
            AlertRule("bytes", "exact", "total_bytes", ">=", 150),
            AlertRule("packets", "exact", "total_packets", "<", 5),
            AlertRule("flows", "exact", "total_flows", "=", 2),
            AlertRule("elsewhere", "absent", "total_bytes", ">", 0),
            AlertRule("metric", "exact", "ByteCount", ">", 0),
            AlertRule("operator", "exact", "total_bytes", "=>", 0),
        ],
    )
    assert fired(alerts_totals(flows, rules, CHECKED_AT)) == [("bytes", None, 150), ("flows", None, 2)]


def test_hitters_and_the_count_alias(spark, hitters):
    rules = rules_frame(
        spark,
        [
            AlertRule("count", "votes", "heavy_hitter_count", ">", 50),
            AlertRule("size", "votes", "heavy_hitter_size", ">", 50),
            AlertRule("alias", "spread", "heavy_hitter_count", ">", 50),
            AlertRule("spread", "spread", "super_spreader_spread", ">", 50),
            AlertRule("not_spread", "votes", "super_spreader_spread", ">", 0),
        ],
    )
    assert fired(alerts_hitters(hitters, rules, CHECKED_AT)) == [
        ("alias", "c", 60), ("count", "a", 90), ("size", "a", 9000),
    ]
    assert fired(alerts_spread(hitters, rules, CHECKED_AT)) == [("spread", "c", 60)]


def test_messages_and_digest(spark, flows, hitters):
    rules = rules_frame(
        spark,
        [
            AlertRule("bytes", "exact", "total_bytes", ">", 149.5),
            AlertRule("any", "votes", "heavy_hitter_count", ">", 1),
            AlertRule("size", "votes", "heavy_hitter_size", ">", 1),
        ],
    )
    alerts = alerts_totals(flows, rules, CHECKED_AT).unionByName(
        alerts_hitters(hitters, rules, CHECKED_AT)
    )
    lines = alert_messages(alerts).orderBy("rule_name", "line_no", F.desc("value"), "flow")
    texts = {}
    for row in lines.collect():
        texts.setdefault(row.rule_name, []).append(row.text)
    assert texts["bytes"] == [
        "Alert: bytes\nTask: exact\nMetric: total_bytes\nCondition: > 149.50\n",
        "Observed value: 150 bytes",
    ]
    assert texts["any"][1:] == ["  a: 90", "  b: 10"]
    digest = alert_digest(alert_messages(alerts)).collect()
    assert {(row.tasks, row.subject) for row in digest} == {(2, "Alert summary (2 triggered)")}
    assert sum(row.line_no == 0 for row in digest) == 3


def test_every_item_is_a_line(spark, hitters):
    rules = rules_frame(spark, [AlertRule("any", "votes", "heavy_hitter_count", ">", 0)])
    many = spark.range(1000).selectExpr(
        "'votes' AS task_name", "concat('f', id) AS flow", "id + 1 AS value", "0 AS type"
    )
    lines = alert_messages(alerts_hitters(many, rules, CHECKED_AT)).collect()
    assert len([row for row in lines if row.line_no == 1]) == 1000
    assert [row.value for row in lines if row.line_no == 0] == [1000]


def test_nothing_fired_gives_no_digest(spark, flows):
    rules = rules_frame(spark, [AlertRule("r", "exact", "total_bytes", ">", 10**9)])
    assert alert_digest(alert_messages(alerts_totals(flows, rules, CHECKED_AT))).count() == 0
