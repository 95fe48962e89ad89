from __future__ import annotations

import pytest
from plans import plan_of

from flowloom.model import AlertRule, ExactTask, SketchTask, key_columns, rules_frame
from flowloom.plans.questions import defined_tasks
from registered.presets import EXACT, VOTE


def test_key_columns_keep_order():
    assert key_columns(["DstPort", "SrcIP"]) == ["dst_port", "src_ip"]


@pytest.mark.parametrize("fields", [["DropTable"], ["SrcIP", "SrcIP"], ["src_ip"]])
def test_bad_key_fields_are_refused(fields):
    with pytest.raises(ValueError):
        ExactTask("task", fields)


def test_zero_selects_sketch_defaults():
    vote = SketchTask("v", 0, ["SrcIP"], width=64)
    assert (vote.width, vote.depth) == (64, 3)
    assert (vote.size_threshold, vote.count_threshold) == (512 * 1024, 512)
    spread = SketchTask("s", 1, ["SrcIP"], ["DstIP"])
    assert (spread.m, spread.lg_k, spread.count_threshold) == (128, 7, 4096)


def test_elements_are_needed_only_for_spread():
    SketchTask("v", 0, ["SrcIP"])
    with pytest.raises(ValueError):
        SketchTask("s", 1, ["SrcIP"])
    with pytest.raises(ValueError):
        SketchTask("x", 2, ["SrcIP"])


def test_rule_problems():
    assert AlertRule("r", "t", "total_bytes", ">", 1).problems() == []
    assert len(AlertRule("r", "t", "ByteCount", "!=", 1).problems()) == 2


def test_small_tables_are_local_relations(spark):
    rules = rules_frame(spark, [AlertRule("r", "t", "total_bytes", ">", 1)])
    assert "LocalTableScan" in plan_of(rules)
    assert rules.first().threshold == 1.0
    assert rules_frame(spark, []).count() == 0


def test_defined_tasks_are_rows_in_order(spark):
    rows = defined_tasks(spark, EXACT, [VOTE]).collect()
    assert [tuple(row) for row in rows] == [
        *((task.name, "exact") for task in EXACT), (VOTE.name, "sketch"),
    ]
