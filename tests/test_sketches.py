from __future__ import annotations

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from flowloom.model import COUNT, SIZE, ExactTask
from flowloom.operators import votes
from flowloom.operators.accuracy import bucket_skew, flow_error_report, sketch_accuracy
from flowloom.operators.flows import exact_spread
from flowloom.operators.registry import (
    Sketch,
    aggregate,
    register_aggregator,
    register_sketch,
    run_sketch,
    sketch,
)
from flowloom.operators.spread import (
    approx_spread,
    merge_spread_registers,
    register_estimates,
    spread_query,
    spread_register_table,
)
from flowloom.operators.votes import (
    lone_flows,
    merge_sketches,
    sketch_hitters,
    sketch_query,
    vote_sketch,
    vote_sketch_closed,
)
from registered.presets import VOTE
from registered.views import lineitem_packets


@pytest.fixture(scope="module")
def packets(spark, sf_dir):
    """Real packets and one source that sends a third of them all."""
    base = lineitem_packets(spark, sf_dir)
    hot = base.where("event_id % 2 = 0").withColumn("src_ip", F.lit("10.9.9.9"))
    return base.unionByName(hot).cache()


def estimates_against_truth(packets, merged, fields, width, depth):
    column = votes.flow_label(fields)
    truth = packets.groupBy(column.alias("flow")).agg(
        F.count("*").alias("n"), F.sum("length").alias("b")
    )
    estimated = sketch_query(merged, truth)
    least = sketch_query(vote_sketch_closed(packets, fields, width, depth), truth.select("flow"))
    joined = estimated.join(
        least.select("flow", F.col("packet_count").alias("ln"), F.col("byte_count").alias("lb")), "flow"
    )
    return joined.collect()


@pytest.mark.parametrize("partitions", [1, 2, 7])
@pytest.mark.parametrize("fields, width", [(["SrcIP"], 4), (["DstIP"], 64), (["SrcIP", "DstPort"], 8)])
def test_votes_stay_inside_their_bounds(packets, partitions, fields, width):
    spread = packets.repartition(partitions, "event_id")
    merged = merge_sketches(vote_sketch(spread, fields, width, 2, tasks=partitions)).cache()
    for row in estimates_against_truth(packets, merged, fields, width, 2):
        assert row.ln <= row.packet_count <= row.n
        assert row.lb <= row.byte_count <= row.b
    assert merged.groupBy("type", "row", "bucket").count().where("count > 1").count() == 0


def test_small_folds_keep_the_bounds(packets, monkeypatch):
    monkeypatch.setattr(votes, "FOLD_ROWS", 50)
    merged = merge_sketches(vote_sketch(packets.repartition(3), ["DstIP"], 32, 2)).cache()
    for row in estimates_against_truth(packets, merged, ["DstIP"], 32, 2):
        assert row.ln <= row.packet_count <= row.n
        assert row.lb <= row.byte_count <= row.b


def test_hot_source_is_found(packets):
    merged = merge_sketches(vote_sketch(packets, ["SrcIP"], 4, 2))
    top = sketch_hitters(merged, 1, 1).where(F.col("type") == COUNT).orderBy(F.desc("value")).first()
    assert top.flow == "10.9.9.9"


def test_sketch_of_nothing_is_empty(packets):
    nothing = merge_sketches(vote_sketch(packets.where("length < 0"), ["SrcIP"], 16, 2))
    assert nothing.count() == 0
    asked = packets.select(F.col("src_ip").alias("flow")).distinct()
    assert sketch_query(nothing, asked).agg(F.max("packet_count")).first()[0] == 0


def test_merging_shuffles_only_leaders(packets):
    plan = plan_of(merge_sketches(vote_sketch(packets, ["SrcIP"], 16, 2)))
    assert plan.index("WindowGroupLimit") < plan.index("MapInArrow")
    assert "Partial" in plan


def test_spread_estimates_are_close(packets):
    truth = exact_spread(packets, ["SrcIP"], ["DstIP"]).withColumnRenamed("spread", "actual")
    registers = register_estimates(spread_register_table(packets, ["SrcIP"], ["DstIP"]))
    for estimates in (approx_spread(packets, ["SrcIP"], ["DstIP"]), registers):
        error = F.abs(F.col("spread") - F.col("actual")) / F.col("actual")
        mean, worst = estimates.join(truth, "flow").agg(F.avg(error), F.max(error)).first()
        assert mean < 0.15 and worst < 0.5


def test_register_tables_merge_to_the_whole(packets):
    whole = spread_register_table(packets, ["SrcIP"], ["DstIP"])
    halves = [
        spread_register_table(packets.where(f"event_id % 2 = {half}"), ["SrcIP"], ["DstIP"])
        for half in (0, 1)
    ]
    merged = merge_spread_registers(halves[0].union(halves[1]))
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0


def test_unknown_flow_has_spread_one(spark, packets):
    asked = spark.createDataFrame([("192.0.2.1",)], "flow string")
    assert spread_query(approx_spread(packets, ["SrcIP"], ["DstIP"]), asked).first().spread == 1


def test_accuracy_of_known_cases(spark):
    detected = spark.createDataFrame([("a", 90), ("b", 50), ("x", 10)], "flow string, value bigint")
    truth = spark.createDataFrame([("a", 100), ("b", 50), ("y", 7)], "flow string, value bigint")
    row = sketch_accuracy(detected, truth).first()
    assert (row.tp, row.fp, row.fn) == (2, 1, 1)
    assert row.mean_relative_error == pytest.approx(0.05)
    assert row.precision == row.recall == row.f1 == pytest.approx(2 / 3)
    none = detected.where("false")
    assert tuple(sketch_accuracy(none, none).first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    report = {r.flow: r.relative_error for r in flow_error_report(detected, truth).collect()}
    assert report == {"a": pytest.approx(0.1), "b": 0.0, "y": 1.0}


def test_even_keys_have_variance_near_mean(spark):
    row = bucket_skew(spark.range(100_000), "id", 256).first()
    assert row.mean_load == pytest.approx(390.625)
    assert 0.7 < row.variance_to_mean < 1.3
    single = spark.range(1000).select(F.lit("same").alias("id"))
    assert bucket_skew(single, "id", 256).first().variance_to_mean > 100


def test_registry(packets):
    register_aggregator("packet_count_test", lambda p, task: p.groupBy(*task.keys).count())
    with pytest.raises(ValueError):
        register_aggregator("packet_count_test", lambda p, task: p)
    with pytest.raises(KeyError):
        aggregate("no_such_aggregator", packets, None)
    with pytest.raises(KeyError):
        sketch("no_such_sketch")
    counted = aggregate("packet_count_test", packets, ExactTask("t", ["Protocol"]))
    assert counted.agg(F.sum("count")).first()[0] == packets.count()
    assert aggregate("exact", packets, ExactTask("t", ["Protocol"])).count() == counted.count()

    flows = lambda p: p.groupBy(F.col("src_ip").alias("flow")).agg(F.sum("length").alias("v"))
    register_sketch(
        "sums_test",
        Sketch(
            build=lambda p, task: flows(p),
            merge=lambda parts: parts.groupBy("flow").agg(F.sum("v").alias("v")),
            query=lambda table, asked: asked.join(table, "flow", "left"),
            hitters=lambda table, task: table.select(
                "flow", F.col("v").alias("value"), F.lit(SIZE).alias("type")
            ).where(F.col("value") >= task.size_threshold),
        ),
    )
    found = run_sketch("sums_test", packets, VOTE)
    assert found.count() == flows(packets).where(F.col("v") >= VOTE.size_threshold).count()


def test_estimates_of_lone_flows_are_the_truth(packets):
    truth = packets.groupBy(F.col("dst_ip").alias("flow")).agg(
        F.count("*").alias("n"), F.sum("length").alias("b")
    )
    lone = lone_flows(truth.select("flow"), 256, 2)
    merged = merge_sketches(vote_sketch(packets, ["DstIP"], 256, 2))
    rows = sketch_query(merged, truth.join(lone, "flow", "left_semi")).collect()
    assert 0 < len(rows) < truth.count()
    assert all((row.packet_count, row.byte_count) == (row.n, row.b) for row in rows)
