"""Named aggregators and sketches that users can add.

An aggregator is a function (packets, task) -> DataFrame. A sketch is a set of
four DataFrame functions around a mergeable table; state lives in that table, so
a new measurement period simply starts from new packets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowloom.model import ExactTask, SketchTask
from flowloom.operators.flows import flow_aggregate
from flowloom.operators.spread import (
    merge_spread_sketches,
    spread_estimates,
    spread_query,
    spread_sketches,
    super_spreaders,
)
from flowloom.operators.votes import merge_sketches, sketch_hitters, sketch_query, vote_sketch

Aggregator = Callable[[DataFrame, object], DataFrame]


@dataclass(frozen=True)
class Sketch:
    """Contract of a sketch.

    build(packets, task) gives partial sketches, merge(parts) combines them,
    query(sketch, flows) estimates given flows, hitters(sketch, task) reports
    (flow, value, type) rows.
    """

    build: Callable[[DataFrame, SketchTask], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    query: Callable[[DataFrame, DataFrame], DataFrame]
    hitters: Callable[[DataFrame, SketchTask], DataFrame]


_aggregators: dict[str, Aggregator] = {}
_sketches: dict[str, Sketch] = {}


def _add(registry: dict, kind: str, name: str, item: object) -> None:
    if name in registry:
        raise ValueError(f"{kind} {name} is already registered")
    registry[name] = item


def _get(registry: dict, kind: str, name: str):
    if name not in registry:
        raise KeyError(f"unknown {kind} {name}, registered: {', '.join(sorted(registry))}")
    return registry[name]


def register_aggregator(name: str, aggregator: Aggregator) -> None:
    """Add an aggregator under a new name."""
    _add(_aggregators, "aggregator", name, aggregator)


def aggregate(name: str, packets: DataFrame, task: object) -> DataFrame:
    """Run the named aggregator."""
    return _get(_aggregators, "aggregator", name)(packets, task)


def register_sketch(name: str, sketch: Sketch) -> None:
    """Add a sketch under a new name."""
    _add(_sketches, "sketch", name, sketch)


def sketch(name: str) -> Sketch:
    """The named sketch."""
    return _get(_sketches, "sketch", name)


def run_sketch(name: str, packets: DataFrame, task: SketchTask) -> DataFrame:
    """Hitters that the named sketch reports for a task."""
    chosen = sketch(name)
    return chosen.hitters(chosen.merge(chosen.build(packets, task)), task)


def _exact(packets: DataFrame, task: ExactTask) -> DataFrame:
    return flow_aggregate(packets, task.key_fields)


def _sketch(packets: DataFrame, task: SketchTask) -> DataFrame:
    return run_sketch(("vote", "spread")[task.kind], packets, task)


register_sketch(
    "vote",
    Sketch(
        build=lambda packets, task: vote_sketch(packets, task.flow_fields, task.width, task.depth),
        merge=merge_sketches,
        query=sketch_query,
        hitters=lambda table, task: sketch_hitters(
            table, task.size_threshold, task.count_threshold
        ),
    ),
)
register_sketch(
    "spread",
    Sketch(
        build=lambda packets, task: spread_sketches(
            packets, task.flow_fields, task.element_fields, task.lg_k
        ),
        merge=merge_spread_sketches,
        query=lambda table, flows: spread_query(spread_estimates(table), flows),
        hitters=lambda table, task: super_spreaders(spread_estimates(table), task.count_threshold),
    ),
)
register_aggregator("exact", _exact)
register_aggregator("sketch", _sketch)
