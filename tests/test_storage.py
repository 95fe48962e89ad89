from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from flowloom.model import FLOW_METRICS_SCHEMA
from flowloom.operators.filters import as_of
from flowloom.session import shared_dir
from flowloom.sinks.tables import (
    compact_table,
    heavy_hitters_scan,
    write_flow_metrics,
    write_heavy_hitters,
    write_hitter_text,
    write_packet_log,
    write_snapshot_dir,
)
from flowloom.sources.packets import (
    decode_payloads,
    encode_payload,
    flow_metrics_scan,
    ingest_quality,
    packets_scan,
    snapshot_scan,
)
from registered.presets import EXACT, flow_metrics, heavy_hitters, task_metrics
from registered.views import event_packets


@pytest.fixture
def metrics_path(spark, sf_dir, tmp_path):
    path = str(tmp_path / "flow_metrics")
    write_flow_metrics(flow_metrics(spark, sf_dir), path)
    return path


def test_repeated_batch_leaves_the_table_unchanged(spark, sf_dir, metrics_path):
    before = flow_metrics_scan(spark, metrics_path).count()
    extra = task_metrics(spark, sf_dir, EXACT[1])
    for _ in range(2):
        write_flow_metrics(extra, metrics_path, "stream", 1)
        assert flow_metrics_scan(spark, metrics_path).count() == before + extra.count()


def test_appends_and_writers_leave_each_other_alone(spark, sf_dir, metrics_path):
    before = flow_metrics_scan(spark, metrics_path).count()
    extra = task_metrics(spark, sf_dir, EXACT[1])
    few = extra.limit(1)
    write_flow_metrics(extra, metrics_path)
    write_flow_metrics(few, metrics_path)
    for writer in ("a", "b"):
        write_flow_metrics(few, metrics_path, writer, 0)
    assert flow_metrics_scan(spark, metrics_path).count() == before + extra.count() + 3


def test_compaction_keeps_the_rows(spark, metrics_path, tmp_path):
    table = flow_metrics_scan(spark, metrics_path)
    compact_table(table, str(tmp_path / "compacted"))
    again = flow_metrics_scan(spark, str(tmp_path / "compacted"))
    names = FLOW_METRICS_SCHEMA.names
    assert again.select(names).exceptAll(table.select(names)).count() == 0
    assert again.count() == table.count()
    assert len(list((tmp_path / "compacted").rglob("*.parquet"))) <= 2


def test_empty_snapshot_adds_no_data_file(spark, sf_dir, metrics_path):
    nothing = task_metrics(spark, sf_dir, EXACT[1]).where("packet_count < 0")
    write_flow_metrics(nothing, metrics_path, "stream", 5)
    assert not list(Path(metrics_path).rglob("batch_id=5/*.parquet"))
    assert flow_metrics_scan(spark, metrics_path).count() > 0


def test_months_are_the_outermost_folders(spark, metrics_path):
    folders = [p.name for p in Path(metrics_path).iterdir() if p.is_dir()]
    assert folders and all(name.startswith("month=") for name in folders)


def test_as_of_prunes_months_and_pushes_the_time(spark, metrics_path):
    plan = plan_of(as_of(flow_metrics_scan(spark, metrics_path), "2024-01-18 00:00:00"))
    assert "(month" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "LessThanOrEqual(snapshot_ts" in plan


def test_snapshot_scan_reads_one_time(spark, metrics_path):
    rows = snapshot_scan(spark, metrics_path, datetime(2024, 1, 18))
    assert {row.snapshot_ts for row in rows.collect()} == {datetime(2024, 1, 18)}


def test_hitter_text_is_descending_within_a_folder(spark, sf_dir, tmp_path):
    path = tmp_path / "text"
    write_hitter_text(heavy_hitters(spark, sf_dir), str(path))
    folders = sorted(path.glob("label=*/task=*/kind=*"))
    assert {folder.name for folder in folders} == {"kind=count_hh", "kind=size_hh", "kind=spread_ss"}
    for folder in folders:
        lines = [line for part in sorted(folder.glob("part-*")) for line in part.read_text().split("\n")]
        values = [int(line.split(" ")[-1]) for line in lines if line]
        assert values == sorted(values, reverse=True)


def test_summary_is_json(spark, sf_dir, tmp_path):
    write_snapshot_dir(task_metrics(spark, sf_dir, EXACT[1]), str(tmp_path / "snap"))
    (part,) = (tmp_path / "snap/summary/label=2024-01-02_00-00-00/task=per_src_ip").glob("*.json")
    summary = json.loads(part.read_text())
    assert set(summary) == {"task_name", "total_flows", "total_bytes", "total_packets"}


def test_packet_log_encodings(spark, sf_dir, tmp_path):
    packets = event_packets(spark, sf_dir)
    write_packet_log(packets, str(tmp_path / "parquet"), "parquet")
    assert packets_scan(spark, str(tmp_path / "parquet")).exceptAll(packets).count() == 0
    with pytest.raises(ValueError):
        write_packet_log(packets, str(tmp_path / "x"), "gob")


def test_heavy_hitters_round_trip(spark, sf_dir, tmp_path):
    hitters = heavy_hitters(spark, sf_dir)
    write_heavy_hitters(hitters, str(tmp_path / "hh"))
    stored = heavy_hitters_scan(spark, str(tmp_path / "hh")).select(hitters.columns)
    assert stored.exceptAll(hitters).count() == hitters.exceptAll(stored).count() == 0


def test_payload_round_trip_keeps_both_address_kinds(spark, packets_of):
    packets = packets_of(
        [
            (datetime(2023, 11, 14, 22, 13, 20), "192.0.2.10", "2001:db8::1", 443, 8080, 17, 128),
            (datetime(2023, 11, 14, 22, 13, 30), "198.51.100.1", "2001:db8::2", 53000, 8443, 6, 256),
        ]
    )
    decoded = decode_payloads(packets.select("event_id", encode_payload().alias("payload")))
    back = decoded.where("NOT bad").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert back.select(packets.columns).exceptAll(packets).count() == 0
    assert back.count() == 2


def test_payload_keeps_nanoseconds(spark):
    text = (
        '{"timestamp_unix_nano": 1700000000000000123, "length": 128, "five_tuple": {"src_ip": "192.0.2.10",'
        ' "dst_ip": "2001:db8::1", "src_port": 443, "dst_port": 8080, "protocol": 17}}'
    )
    row = decode_payloads(spark.createDataFrame([(text,)], "payload string")).first()
    assert (row.ts_nanos, row.bad) == (1700000000000000123, False)


def _payload(src_ip, src_port, protocol):
    key = {"src_ip": src_ip, "dst_ip": "192.0.2.1", "src_port": src_port, "dst_port": 2,
           "protocol": protocol}
    return json.dumps({"timestamp_unix_nano": 1, "length": 5, "five_tuple": key})


def test_addresses_of_payloads_are_canonical(spark):
    message = spark.createDataFrame([(_payload("2001:DB8:0::1", 1, 6),)], "payload string")
    row = decode_payloads(message).first()
    assert (row.src_ip, row.bad) == ("2001:db8::1", False)


@pytest.mark.parametrize(
    "payload",
    [
        "\x08\x01retired encoding",
        "",
        None,
        "[]",
        '{"timestamp_unix_nano": 1, "length": 5}',
        '{"timestamp_unix_nano": 1, "length": 5, "five_tuple": null}',
        '{"timestamp_unix_nano": 1, "length": 5, "five_tuple": {"src_ip": "1.2.3.4"}}',
        '{"length": 5, "five_tuple": {"src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 2, "protocol": 6}}',
        _payload("no address", 1, 6),
        _payload("192.0.2.300", 1, 6),
        _payload("192.0.2.9", 70000, 6),
        _payload("192.0.2.9", 1, 256),
    ],
)
def test_bad_payloads(spark, payload):
    decoded = decode_payloads(spark.createDataFrame([(payload,)], "payload string"))
    assert tuple(ingest_quality(decoded).first()) == (1, 1)


def test_csv_packets(spark, sf_dir, tmp_path):
    packets = event_packets(spark, sf_dir)
    # Without a format, Spark writes milliseconds.
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    packets.write.option("timestampNTZFormat", micros).csv(str(tmp_path / "csv"))
    assert packets_scan(spark, str(tmp_path / "csv"), "csv").exceptAll(packets).count() == 0


def test_shared_folder_is_new_each_time(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def test_stored_schema(spark, metrics_path):
    assert flow_metrics_scan(spark, metrics_path).columns == [
        *FLOW_METRICS_SCHEMA.names, "month", "writer", "batch_id",
    ]
