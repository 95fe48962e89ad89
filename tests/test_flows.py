from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from flowloom.model import FIVE_TUPLE, ExactTask
from flowloom.operators.filters import as_of, filter_flow_keys, filter_flows
from flowloom.operators.flows import flow_aggregate, multi_task_aggregate, snapshot_totals, top_n
from flowloom.operators.lookups import flow_lookup
from flowloom.operators.snapshots import cumulative_snapshots, latest_per_flow, newest_values
from flowloom.plans.questions import aggregate_flows, timeseries_points, trace_flow, trace_requests
from registered.presets import EXACT, flow_metrics
from registered.views import DAY, ORIGIN, PERIOD, event_packets

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def packets(spark, sf_dir):
    return event_packets(spark, sf_dir).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_roll_up_equals_grouping_sets(packets):
    tasks = [*EXACT, ExactTask("again", ["SrcIP"])]
    direct = multi_task_aggregate(packets, tasks, roll_up=False)
    rolled = multi_task_aggregate(packets, tasks, roll_up=True)
    assert rows(direct) == rows(rolled)


def test_task_names_must_differ(packets):
    with pytest.raises(ValueError):
        multi_task_aggregate(packets, [EXACT[0], EXACT[0]])


def test_every_task_counts_every_packet(packets):
    totals = snapshot_totals(multi_task_aggregate(packets, EXACT)).collect()
    assert {row.total_packets for row in totals} == {1000}
    assert len({row.total_bytes for row in totals}) == 1


def test_snapshots_agree_with_packets_up_to_the_time(packets):
    """Inside one period, totals as of a snapshot equal the packets before it."""
    metrics = cumulative_snapshots(packets, EXACT[1], DAY, PERIOD, ORIGIN)
    end = T0 + timedelta(days=7)
    (total,) = aggregate_flows(metrics, end).collect()
    direct = packets.where(F.col("ts") < F.lit(str(end)).cast("timestamp_ntz")).agg(
        F.sum("length"), F.count("*"), F.count_distinct("src_ip")
    ).first()
    assert (total.total_bytes, total.total_packets, total.flow_count) == tuple(direct)


def test_dense_and_sparse_give_the_same_answers(packets):
    build = lambda dense: cumulative_snapshots(
        packets, EXACT[1], DAY, PERIOD, ORIGIN, dense=dense
    )
    sparse, dense = build(False), build(True)
    assert dense.count() > sparse.count()
    for day in (3, 10, 18, 30):
        end = T0 + timedelta(days=day)
        assert rows(aggregate_flows(sparse, end)) == rows(aggregate_flows(dense, end))


def test_every_period_closes_with_a_snapshot(packets_of):
    """An interval that does not divide the period still ends with its period."""
    packets = packets_of(
        [(T0 + timedelta(hours=h), "10.0.0.1", "b", 1, 2, 6, 10) for h in (1, 9, 25)]
    )
    build = lambda dense: cumulative_snapshots(
        packets, ExactTask("t", ["SrcIP"]), timedelta(hours=7), timedelta(hours=24), T0, dense=dense
    )
    stamps = [(row.snapshot_ts - T0) // timedelta(hours=1) for row in build(False).collect()]
    assert sorted(stamps) == [7, 14, 28]
    dense = {(row.snapshot_ts - T0) // timedelta(hours=1): row for row in build(True).collect()}
    assert sorted(dense) == [7, 14, 21, 24, 28]
    assert [dense[hour].packet_count for hour in sorted(dense)] == [1, 2, 2, 2, 1]


def test_latest_row_ignores_order_and_repeats(spark, packets):
    metrics = cumulative_snapshots(packets, EXACT[1], DAY, PERIOD, ORIGIN)
    stale = metrics.withColumn("packet_count", F.col("packet_count") - 1).withColumn(
        "byte_count", F.col("byte_count") - 1
    )
    assert rows(latest_per_flow(stale.union(metrics))) == rows(latest_per_flow(metrics))


def test_filters(spark, sf_dir):
    metrics = flow_metrics(spark, sf_dir)
    assert filter_flows(metrics).count() == metrics.count()
    assert filter_flows(metrics, src_port=0).where("src_port <> 0").count() == 0
    assert filter_flows(metrics, src_ip="").count() == metrics.count()
    assert as_of(metrics, None) is metrics
    with pytest.raises(ValueError):
        filter_flow_keys(metrics, {"DropTable": "1"})


def test_trace_of_nothing_is_epoch_and_zero(spark, sf_dir):
    row = trace_flow(flow_metrics(spark, sf_dir), "per_src_ip", {"SrcIP": "192.0.2.1"}).first()
    assert tuple(row) == (datetime(1970, 1, 1), datetime(1970, 1, 1), 0, 0)


def test_trace_requests_equal_single_traces(spark, sf_dir):
    metrics = flow_metrics(spark, sf_dir).cache()
    asked = [
        (1, "flows_by_tuple", "SrcIP=10.0.0.7", datetime(2024, 1, 12)),
        (2, "flows_by_tuple", " SrcIP = 10.0.0.7 , DstPort=443", None),
        (3, "per_src_ip", "SrcIP=10.0.0.7", datetime(2024, 1, 20)),
        (4, "per_src_ip", "SrcIP=10.0.0.7", datetime(2024, 1, 20)),
        (5, "per_src_ip", "SrcIP=192.0.2.1", None),
        (6, "no_task", "Protocol=6", None),
    ]
    table = spark.createDataFrame(
        asked, "request_id bigint, task_name string, flow_keys string, end_time timestamp_ntz"
    )
    answers = {row.request_id: tuple(row)[1:] for row in trace_requests(metrics, table).collect()}
    assert sorted(answers) == [1, 2, 3, 4, 5, 6]
    for number, task, text, end in asked:
        keys = dict(pair.strip().split("=") for pair in text.replace(" ", "").split(","))
        assert answers[number] == tuple(trace_flow(metrics, task, keys, end).first())


@pytest.mark.parametrize("text", ["SrcIP", "DropTable=1", "", "SrcIP=1.2.3.4,Protocol"])
def test_malformed_requests_fail(spark, sf_dir, text):
    table = spark.createDataFrame(
        [(1, "per_src_ip", text, None)],
        "request_id bigint, task_name string, flow_keys string, end_time timestamp_ntz",
    )
    with pytest.raises(Exception, match="invalid flow keys"):
        trace_requests(flow_metrics(spark, sf_dir), table).collect()


def test_time_series_point(spark, packets_of):
    packets = packets_of([(T0, "10.0.0.1", "b", 1, 2, 6, 10)] * 123)
    metrics = cumulative_snapshots(packets, ExactTask("task", ["SrcIP"]), DAY, PERIOD, ORIGIN)
    end = datetime(2024, 1, 2)
    points = timeseries_points(metrics, ["task", "other"], end).collect()
    assert [tuple(point) for point in points] == [
        ("task", 123, 1704153600000),
        ("other", 0, 1704153600000),
    ]
    assert timeseries_points(metrics, ["task"]).first().total_packets == 123


def test_lookup_of_unknown_keys_is_zero(spark, packets):
    flows = flow_aggregate(packets, ["SrcIP"])
    wanted = spark.createDataFrame([("10.0.0.7",), ("192.0.2.1",)], "src_ip string")
    found = {row.src_ip: row.packet_count for row in flow_lookup(flows, wanted, ["SrcIP"]).collect()}
    assert found["10.0.0.7"] > 0 and found["192.0.2.1"] == 0


def test_newest_values_settle_ties_and_nulls(spark):
    least, most = -(2**63), 2**63 - 1
    rows = [
        ("a", datetime(2024, 1, 1), 9, 9, datetime(1950, 5, 5)),
        ("a", datetime(2024, 1, 2), 3, least, None),
        ("a", datetime(2024, 1, 2), 4, None, datetime(1960, 1, 1)),
        ("b", None, 7, most, None),
        ("c", None, 7, 1, None),
        ("c", datetime(1, 1, 1), None, None, None),
        ("d", datetime(9999, 12, 31), -5, most, datetime(9999, 12, 31, 23, 59, 59, 999999)),
        ("d", datetime(9999, 12, 30), 5, most, datetime(2024, 1, 1)),
        (None, datetime(2024, 1, 1), 1, 1, None),
    ]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, n int, big bigint, t timestamp_ntz")
    newest = newest_values(df, ["k"], ["n", "big", "t"], "at")
    assert {tuple(r) for r in newest.collect()} == {
        ("a", datetime(2024, 1, 2), 4, least, datetime(1960, 1, 1)),
        ("b", None, 7, most, None),
        ("c", datetime(1, 1, 1), None, None, None),
        ("d", datetime(9999, 12, 31), -5, most, datetime(9999, 12, 31, 23, 59, 59, 999999)),
        (None, datetime(2024, 1, 1), 1, 1, None),
    }
    assert newest.schema.simpleString() == "struct<k:string,at:timestamp_ntz,n:int,big:bigint,t:timestamp_ntz>"
    assert "SortAggregate" not in plan_of(newest)


def test_totals_need_no_sort(packets_of):
    packets = packets_of([(datetime(2024, 1, 1), "a", "b", 1, 2, 6, 10)])
    metrics = cumulative_snapshots(packets, ExactTask("t", ["SrcIP"]), timedelta(hours=1), timedelta(days=1))
    assert "SortAggregate" not in plan_of(aggregate_flows(metrics))


def test_top_n_settles_ties_by_key(packets_of):
    packets = packets_of([(T0, f"10.0.0.{i}", "b", 1, 2, 6, 10) for i in (3, 1, 2)])
    assert [row.src_ip for row in top_n(packets, "SrcIP", 2).collect()] == ["10.0.0.1", "10.0.0.2"]


def test_plans_aggregate_before_the_shuffle(packets):
    plan = plan_of(flow_aggregate(packets, FIVE_TUPLE))
    assert "partial_sum" in plan and plan.count("Exchange") == 1
    assert "TakeOrderedAndProject" in plan_of(top_n(packets, "SrcIP", 5))
