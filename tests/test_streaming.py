"""Streams drained over files, compared with the batch operators."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flowloom.model import ExactTask
from flowloom.operators.flows import exact_heavy_hitters, flow_aggregate
from flowloom.operators.snapshots import cumulative_snapshots, latest_per_flow
from flowloom.session import shared_dir
from flowloom.sources.packets import (
    decode_payloads,
    encode_payload,
    flow_metrics_scan,
    observe_quality,
    packets_scan,
    packets_stream,
)
from flowloom.streaming.flows import (
    stream_archive,
    stream_close,
    stream_flows,
    stream_hitters,
    stream_snapshots,
    streamed_hitters,
    streamed_snapshots,
)
from registered import streams
from registered.presets import VOTE
from registered.views import DAY, ORIGIN, event_packets

TASK = ExactTask("per_src_ip", ["SrcIP"])
LONG = timedelta(days=400)


@pytest.fixture
def arrivals(spark, sf_dir, tmp_path):
    """Packets of the first half of the time, then the second half, as files."""
    packets = event_packets(spark, sf_dir)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    folder = str(tmp_path / "arrivals")

    def arrive(part: str) -> None:
        which = early if part == "early" else ~early
        packets.where(which).coalesce(2).write.mode("append").parquet(folder)

    return packets, folder, arrive


def totals(flows):
    return sorted(
        (r.src_ip, r.start_time, r.end_time, r.byte_count, r.packet_count) for r in flows.collect()
    )


def drain(spark, folder, path, checkpoint, lateness=LONG, period=LONG, **options):
    stream_close(
        stream_snapshots, packets_stream(spark, folder, **options), TASK, DAY, period, path,
        checkpoint, origin=ORIGIN, lateness=lateness,
    )


def test_stream_equals_batch_over_several_batches(spark, arrivals, tmp_path):
    packets, folder, arrive = arrivals
    arrive("early")
    arrive("late")
    path = str(tmp_path / "table")
    drain(spark, folder, path, str(tmp_path / "cp"), maxFilesPerTrigger=1)
    stored = flow_metrics_scan(spark, path)
    assert stored.select("batch_id").distinct().count() >= 2
    assert stored.select("writer").distinct().count() == 1
    # At every snapshot, not only the last one.
    streamed = streamed_snapshots(spark, path)
    batch = cumulative_snapshots(packets, TASK, DAY, LONG, ORIGIN)
    assert streamed.count() == batch.count()
    assert streamed.select(batch.columns).exceptAll(batch).count() == 0


def test_restart_continues_from_the_checkpoint(spark, arrivals, tmp_path):
    packets, folder, arrive = arrivals
    path, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")
    arrive("early")
    drain(spark, folder, path, checkpoint)
    first = latest_per_flow(streamed_snapshots(spark, path)).agg(F.sum("packet_count")).first()[0]
    assert first < packets.count()
    arrive("late")
    drain(spark, folder, path, checkpoint)
    drain(spark, folder, path, checkpoint)
    assert totals(latest_per_flow(streamed_snapshots(spark, path))) == totals(
        flow_aggregate(packets, ["SrcIP"])
    )


def test_late_packets_are_dropped_and_counted(spark, arrivals, tmp_path):
    packets, folder, arrive = arrivals
    path, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")
    arrive("late")
    drain(spark, folder, path, checkpoint, lateness=DAY, period=DAY)
    arrive("early")
    stream = packets_stream(spark, folder)
    query = stream_snapshots(
        stream, TASK, DAY, DAY, path, checkpoint, origin=ORIGIN, lateness=DAY
    )
    query.awaitTermination()
    dropped = sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
    assert dropped > 0
    newest = streamed_snapshots(spark, path).groupBy("period_start", "src_ip").agg(
        F.max("packet_count").alias("n")
    )
    on_time = packets.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    assert newest.agg(F.sum("n")).first()[0] == on_time.count()


def test_state_is_looked_up_once_per_row(spark, arrivals, tmp_path):
    _, folder, arrive = arrivals
    arrive("early")
    query = stream_snapshots(
        packets_stream(spark, folder), TASK, DAY, LONG, str(tmp_path / "table"),
        str(tmp_path / "cp"), origin=ORIGIN, lateness=DAY,
    )
    query.awaitTermination()
    (state,) = query.recentProgress[0]["stateOperators"]
    assert 0 < state["customMetrics"]["rocksdbGetCount"] <= state["numRowsUpdated"]


def test_files_of_an_arrival_follow_its_packets(spark, sf_dir, tmp_path, monkeypatch):
    folder = tmp_path / "arrivals"
    monkeypatch.setattr(streams, "shared_dir", lambda *_: str(folder))
    monkeypatch.setattr(streams, "ARRIVAL_ROWS", 100)
    stream = streams._arrivals(spark, sf_dir)
    count = event_packets(spark, sf_dir).count()
    assert len(list(folder.glob("*.parquet"))) == 3 * -(-count // 300) > 3
    monkeypatch.undo()
    query = stream_snapshots(
        stream, TASK, DAY, LONG, str(tmp_path / "table"), str(tmp_path / "cp"), origin=ORIGIN,
        lateness=LONG,
    )
    query.awaitTermination()
    filled = [progress["numInputRows"] > 0 for progress in query.recentProgress]
    assert filled.count(True) == 3
    newest = latest_per_flow(streamed_snapshots(spark, str(tmp_path / "table")))
    assert newest.agg(F.sum("packet_count")).first()[0] == count


def test_hitters_equal_batch(spark, arrivals, tmp_path):
    packets, folder, arrive = arrivals
    arrive("early")
    arrive("late")
    path = str(tmp_path / "hh")
    stream_close(
        stream_hitters, packets_stream(spark, folder, maxFilesPerTrigger=1), VOTE, DAY, LONG, path,
        str(tmp_path / "cp"), origin=ORIGIN, lateness=LONG,
    )
    newest = streamed_hitters(spark, path, VOTE).groupBy("flow", "type").agg(F.max("value").alias("v"))
    truth = exact_heavy_hitters(packets, ["SrcIP"], "packets", VOTE.count_threshold).unionByName(
        exact_heavy_hitters(packets, ["SrcIP"], "bytes", VOTE.size_threshold)
    )
    found = {(r.flow, r.type): r.v for r in newest.collect()}
    assert found == {(r.flow, r.type): r.value for r in truth.collect()}


def test_archive_keeps_every_packet(spark, arrivals, tmp_path):
    packets, folder, arrive = arrivals
    arrive("early")
    arrive("late")
    path = str(tmp_path / "archive")
    stream_close(stream_archive, packets_stream(spark, folder), path, str(tmp_path / "cp"))
    assert packets_scan(spark, path).exceptAll(packets).count() == 0
    assert packets_scan(spark, path).count() == packets.count()


def test_bad_messages_are_not_forwarded(spark, sf_dir, tmp_path):
    """Messages through a stream: bad ones are counted and left out of the flows."""
    folder = str(tmp_path / "messages")
    payload = F.when(F.col("protocol") == 17, F.lit("retired")).otherwise(encode_payload())
    packets = event_packets(spark, sf_dir)
    packets.select(payload.alias("payload")).write.parquet(folder)
    messages = spark.readStream.schema("payload string").parquet(folder)
    decoded = observe_quality(decode_payloads(messages), "quality").where("NOT bad")
    path = str(tmp_path / "table")
    query = stream_snapshots(
        decoded, TASK, DAY, LONG, path, str(tmp_path / "cp"), origin=ORIGIN, lateness=LONG
    )
    query.awaitTermination()
    quality = [p["observedMetrics"]["quality"] for p in query.recentProgress if p["numInputRows"]]
    good = packets.where("protocol <> 17")
    assert sum(q["failed"] for q in quality) == packets.count() - good.count()
    assert totals(latest_per_flow(streamed_snapshots(spark, path))) == totals(
        flow_aggregate(good, ["SrcIP"])
    )


def test_stream_plan_keeps_state_by_flow(spark, arrivals):
    _, folder, arrive = arrivals
    arrive("early")
    flows = stream_flows(packets_stream(spark, folder), TASK, DAY, LONG, ORIGIN)
    assert flows.isStreaming and shared_dir(spark, "x")
    assert flows.columns[:4] == ["window", "period_start", "task_name", "src_ip"]
