"""The vote sketch: depth x width buckets that each elect one heavy flow.

Every bucket keeps a candidate flow and a vote, separately for packets (type 0)
and bytes (type 1). A vote never exceeds the flow's true total, and a flow with
total n in a bucket with total V keeps a vote of at least 2n - V: the guarantee of
a one-counter frequent-items summary, which survives merging (Agarwal et al.,
"Mergeable Summaries", 2012). A sketch is a table

    (type, row, bucket, flow, vote)

so partial sketches of partitions, days or sites merge with one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.hashing import seeded_bucket, seeded_buckets
from flowloom.functions.keys import flow_label
from flowloom.model import COUNT, SIZE
from flowloom.session import parallelism

SKETCH_SCHEMA = "type int, row int, bucket int, flow string, vote bigint"

# Packets folded into the sketch at a time; bounds the memory beside the sketch.
FOLD_ROWS = 1 << 18


def vote_sketch(
    packets: DataFrame,
    fields: Iterable[str],
    width: int,
    depth: int,
    method: str = "xxhash64",
    tasks: int | None = None,
) -> DataFrame:
    """Partial sketches, one per task; combine them with `merge_sketches`.

    Packets are not shuffled. A task holds one sketch of fixed size and emits at
    most 2 x depth x width rows, however many packets and flows pass through it.
    A large scan has many more splits than the cluster has cores, and a sketch per
    split would make the merge outgrow the data; so splits are chained into at most
    `tasks` tasks (default: the session's parallelism).
    """
    label = flow_label(fields)
    hashed = packets.coalesce(tasks or parallelism(packets.sparkSession)).select(
        label.alias("flow"),
        "length",
        *[
            seeded_bucket(F.lit(row), label, width, method).alias(f"bucket_{row}")
            for row in range(depth)
        ],
    )
    return hashed.mapInArrow(_partition_sketch(width, depth, FOLD_ROWS), SKETCH_SCHEMA)


def _partition_sketch(width: int, depth: int, fold_rows: int) -> Callable:
    """Arrow stage that elects candidates over the batches of one partition."""
    import numpy as np
    import pyarrow as pa

    def elect(buckets, totals):
        """Per bucket: index of the largest flow and its lead over the second largest."""
        order = np.lexsort((-totals, buckets))
        sorted_buckets = buckets[order]
        is_first = np.ones(len(order), dtype=bool)
        is_first[1:] = sorted_buckets[1:] != sorted_buckets[:-1]
        first = np.flatnonzero(is_first)
        after = np.minimum(first + 1, len(order) - 1)
        has_second = (first + 1 < len(order)) & ~is_first[after]
        second = np.where(has_second, totals[order[after]], 0)
        winners = order[first]
        lead = totals[winners] - second
        return winners[lead > 0], lead[lead > 0]

    def fold(table, candidates, votes):
        """Add a table of packets to the sketch."""
        measures = [("length", "count"), ("length", "sum")]
        places = [(f"bucket_{row}", "min") for row in range(depth)]
        flows = table.group_by("flow", use_threads=False).aggregate(measures + places)
        names = flows["flow"].combine_chunks()
        totals_of = {
            COUNT: flows["length_count"].to_numpy(),
            SIZE: flows["length_sum"].to_numpy(),
        }
        for row in range(depth):
            buckets = flows[f"bucket_{row}_min"].to_numpy()
            for kind, totals in totals_of.items():
                winners, lead = elect(buckets, totals)
                slots = row * width + buckets[winners]
                challenger = names.take(pa.array(winners)).to_numpy(zero_copy_only=False)
                held = votes[kind][slots]
                incumbent = candidates[kind][slots]
                agree = incumbent == challenger
                votes[kind][slots] = np.where(agree, held + lead, np.abs(held - lead))
                candidates[kind][slots] = np.where(agree | (held >= lead), incumbent, challenger)

    def run(batches: Iterator) -> Iterator:
        votes = {kind: np.zeros(depth * width, dtype=np.int64) for kind in (COUNT, SIZE)}
        candidates = {kind: np.empty(depth * width, dtype=object) for kind in (COUNT, SIZE)}
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= fold_rows:
                fold(pa.Table.from_batches(waiting), candidates, votes)
                waiting, rows = [], 0
        if rows:
            fold(pa.Table.from_batches(waiting), candidates, votes)
        for kind in (COUNT, SIZE):
            elected = np.flatnonzero(votes[kind] > 0)
            for start in range(0, len(elected), fold_rows):
                slots = elected[start : start + fold_rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(slots), kind, dtype=np.int32)),
                        pa.array((slots // width).astype(np.int32)),
                        pa.array((slots % width).astype(np.int32)),
                        pa.array(candidates[kind][slots], type=pa.string()),
                        pa.array(votes[kind][slots]),
                    ],
                    names=["type", "row", "bucket", "flow", "vote"],
                )

    return run


def vote_sketch_closed(
    packets: DataFrame,
    fields: Iterable[str],
    width: int,
    depth: int,
    method: str = "xxhash64",
) -> DataFrame:
    """Order-independent sketch: the largest flow of a bucket with 2 max - total.

    It shuffles every flow, so it serves verification and moderate key counts.
    """
    totals = packets.groupBy(flow_label(fields).alias("flow")).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("length").alias("byte_count")
    )
    placed = totals.select(
        "flow",
        F.explode(seeded_buckets(F.col("flow"), depth, width, method)).alias("place"),
        "packet_count",
        "byte_count",
    )
    typed = placed.select(
        "flow",
        "place.row",
        "place.bucket",
        F.explode(
            F.array(
                F.struct(F.lit(COUNT).alias("type"), F.col("packet_count").alias("total")),
                F.struct(F.lit(SIZE).alias("type"), F.col("byte_count").alias("total")),
            )
        ).alias("measure"),
    ).select("flow", "row", "bucket", "measure.type", "measure.total")
    return (
        typed.groupBy("type", "row", "bucket")
        .agg(F.max(F.struct("total", "flow")).alias("top"), F.sum("total").alias("all"))
        .select(
            "type", "row", "bucket", "top.flow", (F.col("top.total") * 2 - F.col("all")).alias("vote")
        )
        .where(F.col("vote") > 0)
    )


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Combined sketch of partial sketches with equal width, depth and hash.

    Votes of one flow add up, then each bucket keeps its leader minus its second.
    The top two of a bucket are picked inside each task before they are shuffled.
    """
    cell = ["type", "row", "bucket"]
    summed = parts.groupBy(*cell, "flow").agg(F.sum("vote").alias("vote"))
    order = W.partitionBy(*cell).orderBy(F.desc("vote"), F.asc("flow"))
    leaders = summed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2)
    return (
        leaders.groupBy(*cell)
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("flow"))).alias("flow"),
            F.max(F.when(F.col("place") == 1, F.col("vote"))).alias("first"),
            F.max(F.when(F.col("place") == 2, F.col("vote"))).alias("second"),
        )
        .select(*cell, "flow", (F.col("first") - F.coalesce("second", F.lit(0))).alias("vote"))
        .where(F.col("vote") > 0)
    )


def sketch_query(sketch: DataFrame, flows: DataFrame) -> DataFrame:
    """Estimated packets and bytes of each given flow: its best row, 0 when unseen.

    A flow can only lead the buckets it hashes to, so its text alone finds them.
    """

    def best(kind: int, name: str):
        return F.max(F.when(F.col("type") == kind, F.col("vote"))).alias(name)

    estimates = sketch.groupBy("flow").agg(best(COUNT, "packet_count"), best(SIZE, "byte_count"))
    return flows.join(estimates, "flow", "left").select(
        *flows.columns,
        F.coalesce("packet_count", F.lit(0)).alias("packet_count"),
        F.coalesce("byte_count", F.lit(0)).alias("byte_count"),
    )


def lone_flows(
    flows: DataFrame, width: int, depth: int, method: str = "xxhash64"
) -> DataFrame:
    """The given distinct flows that have one of their buckets to themselves, as `flow`.

    Their estimates in a sketch of these flows are the truth. Of the others a sketch of that
    width can only tell bounds.
    """
    placed = flows.select(
        "flow", F.explode(seeded_buckets(F.col("flow"), depth, width, method)).alias("place")
    )
    return (
        placed.groupBy("place.row", "place.bucket")
        .agg(F.min("flow").alias("flow"), F.count(F.lit(1)).alias("flows"))
        .where("flows = 1")
        .select("flow")
        .distinct()
    )


def sketch_hitters(sketch: DataFrame, size_threshold: int, count_threshold: int) -> DataFrame:
    """(flow, value, type) of candidates whose best vote reaches the type's threshold."""
    threshold = F.when(F.col("type") == SIZE, size_threshold).otherwise(count_threshold)
    return (
        sketch.groupBy("type", "flow")
        .agg(F.max("vote").alias("value"))
        .where(F.col("value") >= threshold)
        .select("flow", "value", "type")
    )
