"""Threshold rules over task totals and reported hitters.

Rules are a small table. Pairing rules with values is an equi-join on the task and
what is measured, without a broadcast hint: Spark broadcasts the rules when their
size allows it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.checks import check
from flowloom.functions.times import ntz
from flowloom.model import COUNT, SIZE, SPREAD, TOTAL_METRICS
from flowloom.operators.flows import snapshot_totals

RULE = ["rule_name", "task_name", "metric", "operator", "threshold"]
ALERT = ["check_ts", *RULE, "flow", "value"]


def rules_for_tasks(rules: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Rule and value pairs of the same task whose comparison holds."""
    paired = values.join(rules, on)
    value = F.col("value").cast("double")
    return paired.where(check(value, F.col("operator"), F.col("threshold")))


def _alerts(fired: DataFrame, check_ts: datetime | str | Column) -> DataFrame:
    return fired.withColumn("check_ts", ntz(check_ts)).select(*ALERT)


def alerts_totals(
    flows: DataFrame, rules: DataFrame, check_ts: datetime | str | Column
) -> DataFrame:
    """Rules on total_packets, total_bytes and total_flows of the tasks' flows."""
    totals = snapshot_totals(flows).unpivot(
        "task_name", list(TOTAL_METRICS), "metric", "value"
    )
    fired = rules_for_tasks(rules, totals, ["task_name", "metric"])
    return _alerts(fired.withColumn("flow", F.lit(None).cast("string")), check_ts)


def _typed(rules: DataFrame, types_of: dict[str, tuple[int, ...]]) -> DataFrame:
    """Rules of the given metrics, once per hitter type that they read."""
    types = F.lit(None).cast("array<int>")
    for metric, codes in types_of.items():
        types = F.when(F.col("metric") == metric, F.array(*map(F.lit, codes))).otherwise(types)
    return rules.withColumn("type", F.explode(types))


def alerts_hitters(
    hitters: DataFrame, rules: DataFrame, check_ts: datetime | str | Column
) -> DataFrame:
    """Rules on heavy_hitter_count and heavy_hitter_size: a row per triggering flow.

    Spread tasks report their spreads as counts, so heavy_hitter_count also reads
    hitters of type 2. Rules see only what a task reports: a threshold below the
    task's own has no effect.
    """
    typed = _typed(rules, {"heavy_hitter_count": (COUNT, SPREAD), "heavy_hitter_size": (SIZE,)})
    return _alerts(rules_for_tasks(typed, hitters, ["task_name", "type"]), check_ts)


def alerts_spread(
    hitters: DataFrame, rules: DataFrame, check_ts: datetime | str | Column
) -> DataFrame:
    """Rules on super_spreader_spread: a row per triggering flow of spread tasks."""
    typed = _typed(rules, {"super_spreader_spread": (SPREAD,)})
    return _alerts(rules_for_tasks(typed, hitters, ["task_name", "type"]), check_ts)


LINE = ["check_ts", "tasks", "subject", *RULE, "line_no", "value", "flow", "text"]


def alert_messages(alerts: DataFrame) -> DataFrame:
    """The lines of a message per check and rule: a header, then every item.

    Line 0 is the header; items have line 1 and stand in the order of `value`
    (descending) and `flow`. A rule that fires for very many flows stays as many rows
    in as many tasks: nothing is gathered, numbered or left out.
    """
    unit = (
        F.when(F.col("metric") == "total_packets", " packets")
        .when(F.col("metric") == "total_flows", " flows")
        .when(F.col("metric").isin("total_bytes", "heavy_hitter_size"), " bytes")
        .otherwise("")
    )
    item = F.concat(
        F.when(F.col("flow").isNull(), "Observed value: ").otherwise(
            F.concat(F.lit("  "), "flow", F.lit(": "))
        ),
        F.col("value").cast("string"),
        unit,
    )
    header = F.format_string(
        "Alert: %s\nTask: %s\nMetric: %s\nCondition: %s %.2f\n",
        "rule_name",
        "task_name",
        "metric",
        "operator",
        "threshold",
    )
    rule = ["check_ts", *RULE]
    items = alerts.select(*rule, F.lit(1).alias("line_no"), "value", "flow", item.alias("text"))
    headers = (
        alerts.groupBy(*rule)
        .agg(F.count(F.lit(1)).alias("value"))
        .select(
            *rule,
            F.lit(0).alias("line_no"),
            "value",
            F.lit(None).cast("string").alias("flow"),
            header.alias("text"),
        )
    )
    return headers.unionByName(items)


def alert_digest(messages: DataFrame) -> DataFrame:
    """The lines of a check with its subject, which counts tasks that fired, not rules.

    In the order of task, rule, line, value (descending) and flow, the texts of a check
    are its body.
    """
    checks = (
        messages.where("line_no = 0")
        .groupBy("check_ts")
        .agg(F.count_distinct("task_name").cast("int").alias("tasks"))
        .withColumn("subject", F.format_string("Alert summary (%d triggered)", "tasks"))
    )
    return messages.join(checks, "check_ts").select(*LINE)
