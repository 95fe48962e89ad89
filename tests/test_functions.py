from __future__ import annotations

import ipaddress
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.functions.addresses import canonical_ip
from flowloom.functions.checks import check
from flowloom.functions.hashing import register_rank, seeded_bucket
from flowloom.functions.keys import flow_key, l4_ports, pad_missing_keys, project_key
from flowloom.functions.times import (
    grid,
    nanos_to_ts,
    packet_line,
    parse_snapshot_label,
    snapshot_label,
    ts_to_nanos,
)
from flowloom.model import FIVE_TUPLE

GROUP = st.sampled_from(["0", "0", "0", "0000", "1", "00a0", "FFFF", "db8", "beef"])
V6 = st.lists(GROUP, min_size=8, max_size=8).map(":".join)
SHORT = V6.map(lambda text: str(ipaddress.ip_address(text)))
OCTETS = st.lists(st.integers(0, 299).map(str), min_size=4, max_size=4).map(".".join)
MAPPED = OCTETS.map("::ffff:{}".format)
EMBEDDED = OCTETS.map("64:ff9b::{}".format)
BROKEN = st.builds(
    lambda text, at, mark: text[: at % len(text)] + mark + text[at % len(text) :],
    V6 | SHORT,
    st.integers(0, 60),
    st.sampled_from([":", "g", "::", "1.2"]),
)


def canonical(text: str) -> str | None:
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return str(getattr(address, "ipv4_mapped", None) or address)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(V6 | SHORT | OCTETS | MAPPED | EMBEDDED | BROKEN, min_size=150, max_size=150))
def test_addresses_follow_the_standard_text(spark, texts):
    rows = spark.createDataFrame([(text,) for text in texts], "a string")
    for row in rows.select("a", canonical_ip("a").alias("c")).collect():
        assert row.c == canonical(row.a), row.a


@pytest.mark.parametrize(
    "text, expected",
    [
        ("010.001.0.9", "10.1.0.9"),
        (" 10.0.0.1 ", "10.0.0.1"),
        ("::", "::"),
        ("1:0:0:2:0:0:0:3", "1:0:0:2::3"),
        ("1:0:0:2:0:0:3:4", "1::2:0:0:3:4"),
        ("::FFFF:192.0.2.10", "192.0.2.10"),
        ("1.2.3", None),
        ("1:2:3:4:5:6:7:8:9", None),
        ("::ffff:1.2.3.400", None),
        ("", None),
    ],
)
def test_address_examples(spark, text, expected):
    row = spark.createDataFrame([(text,)], "a string").select(canonical_ip("a").alias("c")).first()
    assert row.c == expected


@pytest.mark.parametrize("operator", [">", "<", "=", ">=", "<=", "!=", ""])
@pytest.mark.parametrize("value", [4.0, 5.0, 6.0])
def test_check(spark, operator, value):
    held = {">": value > 5, "<": value < 5, "=": value == 5, ">=": value >= 5, "<=": value <= 5}
    row = spark.range(1).select(check(F.lit(value), F.lit(operator), F.lit(5.0)).alias("c")).first()
    assert row.c == held.get(operator, False)


def test_nanos_round_down(spark):
    rows = spark.createDataFrame([(1_700_000_000_123_456_789,), (-1,)], "n bigint")
    back = rows.select(ts_to_nanos(nanos_to_ts(F.col("n"))).alias("n")).collect()
    assert [row.n for row in back] == [1_700_000_000_123_456_000, -1000]


def test_label_round_trip(spark, packets_of):
    packets = packets_of([(datetime(2024, 1, 5, 10, 11, 12, 999), "a", "b", 1, 2, 6, 64)])
    row = packets.select(snapshot_label(F.col("ts")).alias("l")).select(
        "l", parse_snapshot_label(F.col("l")).alias("p")
    ).first()
    assert (row.l, row.p) == ("2024-01-05_10-11-12", datetime(2024, 1, 5, 10, 11, 12))


def test_log_line(packets_of):
    packets = packets_of(
        [(datetime(2023, 11, 14, 22, 13, 22, 1999), "10.0.0.1", "10.0.0.2", 1234, 80, 6, 512)]
    )
    line = packets.select(packet_line().alias("line")).first().line
    assert line == "2023-11-14 22:13:22.001 - 10.0.0.1:1234 -> 10.0.0.2:80, Proto: 6, Len: 512"


def test_grid_is_aligned_to_the_origin(packets_of):
    packets = packets_of([(datetime(2024, 1, 15), "a", "b", 1, 2, 6, 64)])
    cell = packets.select(
        grid("ts", timedelta(days=10), datetime(2024, 1, 1)).alias("g")
    ).first().g
    assert (cell.start, cell.end) == (datetime(2024, 1, 11), datetime(2024, 1, 21))


def test_keys(packets_of):
    packets = packets_of([(datetime(2024, 1, 1), "10.0.0.1", "10.0.0.2", 1234, 80, 1, 64)])
    assert packets.select(flow_key(FIVE_TUPLE).alias("k")).first().k == "10.0.0.1-10.0.0.2-1234-80-1"
    assert project_key(packets, ["DstPort", "SrcIP"]).columns == ["dst_port", "src_ip"]
    ports = l4_ports(packets).first()
    assert (ports.src_port, ports.dst_port) == (0, 0)
    padded = pad_missing_keys(packets.select("src_ip", "length"), ["SrcIP"])
    assert padded.first() == ("10.0.0.1", None, None, None, None, 64)
    with pytest.raises(ValueError):
        project_key(packets, ["DropTable"])


def test_ranks_are_geometric_and_capped(spark):
    ranks = spark.range(20000).select(
        register_rank(F.col("id").cast("string"), 3).alias("r"),
        seeded_bucket(F.lit(1), F.col("id").cast("string"), 16).alias("b"),
    )
    row = ranks.agg(F.min("r"), F.max("r"), F.count_if(F.col("r") == 1), F.count_distinct("b")).first()
    assert (row[0], row[1], row[3]) == (1, 7, 16)
    assert 9500 < row[2] < 10500


def test_unknown_hash_is_refused():
    with pytest.raises(ValueError):
        seeded_bucket(F.lit(0), F.lit("a"), 8, "crc32")
