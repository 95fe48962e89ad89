"""Capture decoding on files made by the tests."""

from __future__ import annotations

import struct
import time
from datetime import datetime
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.sources import captures
from flowloom.sources.captures import capture_ranges, capture_records, pcap_scan
from flowloom.sources.packets import ingest_quality
from registered.capture_files import block, write_captures
from registered.synthetic import synthetic_packets
from registered.views import lineitem_packets

TIME = 1_700_000_000


def ethernet(ether_type, payload, vlans=()):
    tags = b"".join(struct.pack(">HH", kind, 7) for kind in vlans)
    return bytes(12) + tags + struct.pack(">H", ether_type) + payload


def ipv4(protocol, payload, flags=0, options=b""):
    words = 5 + len(options) // 4
    head = struct.pack(">BBHHHBBH", 0x40 | words, 0, 0, 0, flags, 64, protocol, 0)
    return head + bytes([192, 0, 2, 10]) + bytes([198, 51, 100, 20]) + options + payload


def ipv6(next_header, payload):
    source = bytes.fromhex("20010db8000000000000000000000001")
    target = bytes.fromhex("20010db8000000010000000000000002")
    return struct.pack(">IHBB", 6 << 28, len(payload), next_header, 64) + source + target + payload


def tcp(source, target):
    return struct.pack(">HHIIBBHHH", source, target, 0, 0, 0x50, 2, 0, 0, 0)


def udp(source, target):
    return struct.pack(">HHHH", source, target, 8, 0)


def capture(frames, order="<", magic=0xA1B2C3D4, link_type=1, fraction=123):
    head = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, link_type)
    records = [
        struct.pack(f"{order}IIII", TIME + i, fraction, len(frame), len(frame) + 100) + frame
        for i, frame in enumerate(frames)
    ]
    return head + b"".join(records)


def read(spark, folder, name, content, **options):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)
    return capture_records(spark, str(folder), **options).orderBy("ts_nanos").collect()


def test_kinds_of_packets(spark, tmp_path):
    frames = [
        ethernet(0x0800, ipv4(6, tcp(443, 8443))),
        ethernet(0x0800, ipv4(17, udp(53, 5353)), vlans=[0x8100]),
        ethernet(0x0800, ipv4(6, tcp(1, 2), options=bytes(8)), vlans=[0x88A8, 0x8100]),
        ethernet(0x0800, ipv4(1, bytes(8))),
        ethernet(0x0800, ipv4(6, tcp(3, 4), flags=0x2000)),
        ethernet(0x86DD, ipv6(17, udp(443, 8080))),
        ethernet(0x86DD, ipv6(0, bytes([60, 0]) + bytes(6) + bytes([6, 1]) + bytes(14) + tcp(5, 6))),
        ethernet(0x0800, ipv4(6, tcp(7, 8)[:12])),
        ethernet(0x0806, bytes(28)),
        ethernet(0x0800, ipv4(6, b"")[:12]),
    ]
    rows = read(spark, tmp_path / "in", "a.pcap", capture(frames))
    seen = [(r.ip_version, r.protocol, r.src_port, r.dst_port, r.bad) for r in rows]
    assert seen == [
        (4, 6, 443, 8443, False),
        (4, 17, 53, 5353, False),
        (4, 6, 1, 2, False),
        (4, 1, 0, 0, False),
        (4, 6, 0, 0, False),
        (6, 17, 443, 8080, False),
        (6, 0, 5, 6, False),
        (4, 6, 0, 0, False),
        (0, 0, 0, 0, True),
        (0, 0, 0, 0, True),
    ]
    assert (rows[0].src_ip, rows[0].dst_ip) == ("192.0.2.10", "198.51.100.20")
    assert (rows[5].src_ip, rows[5].dst_ip) == ("2001:db8::1", "2001:db8:0:1::2")
    assert rows[8].src_ip is None
    assert rows[0].length == len(frames[0]) + 100
    assert rows[0].ts == datetime(2023, 11, 14, 22, 13, 20, 123)

    packets = pcap_scan(spark, str(tmp_path / "in"))
    assert packets.count() == 8 and "bad" not in packets.columns
    quality = ingest_quality(capture_records(spark, str(tmp_path / "in"))).first()
    assert (quality.total, quality.failed) == (10, 2)


def mpls(*labels, payload):
    words = [label << 12 | (i == len(labels) - 1) << 8 | 64 for i, label in enumerate(labels)]
    return b"".join(struct.pack(">I", word) for word in words) + payload


def pppoe(protocol, payload):
    return struct.pack(">BBHH", 0x11, 0, 7, len(payload) + 2) + protocol + payload


def gre(ether_type, payload, flags=0, options=b""):
    return struct.pack(">HH", flags, ether_type) + options + payload


INNER4, INNER6 = ipv4(6, tcp(443, 80)), ipv6(17, udp(53, 99))
# Frame, then version and protocol of the header that counts, and the ports.
NESTED = {
    "mpls": (ethernet(0x8847, mpls(16, payload=INNER4)), 4, 6, 443, 80),
    "three labels": (ethernet(0x8848, mpls(16, 17, 18, payload=INNER6)), 6, 17, 53, 99),
    "frame in mpls": (ethernet(0x8847, mpls(16, payload=ethernet(0x0800, INNER4))), 4, 6, 443, 80),
    "tagged mpls": (ethernet(0x8847, mpls(16, payload=INNER4), vlans=[0x8100]), 4, 6, 443, 80),
    "pppoe": (ethernet(0x8864, pppoe(b"\x00\x21", INNER4)), 4, 6, 443, 80),
    "pppoe short": (ethernet(0x8864, pppoe(b"\x57", INNER6)), 6, 17, 53, 99),
    "pppoe control": (ethernet(0x8864, pppoe(b"\xc0\x21", bytes(20))), 0, 0, 0, 0),
    "4 in 4": (ethernet(0x0800, ipv4(4, INNER4)), 4, 4, 443, 80),
    "4 in 6": (ethernet(0x86DD, ipv6(4, INNER4)), 4, 6, 443, 80),
    "6 in 4": (ethernet(0x0800, ipv4(41, INNER6)), 4, 41, 53, 99),
    "6 in 6": (ethernet(0x86DD, ipv6(41, INNER6)), 6, 41, 53, 99),
    "gre": (ethernet(0x0800, ipv4(47, gre(0x0800, INNER4))), 4, 47, 443, 80),
    "gre with key": (
        ethernet(0x0800, ipv4(47, gre(0x86DD, INNER6, 0xB000, bytes(12)))), 4, 47, 53, 99,
    ),
    "gre bridge": (
        ethernet(0x86DD, ipv6(47, gre(0x6558, ethernet(0x0800, INNER4)))), 4, 6, 443, 80,
    ),
    "gre tag": (ethernet(0x0800, ipv4(47, gre(0x8100, b"\x00\x07\x08\x00" + INNER4))), 4, 47, 443, 80),
    "pptp": (
        ethernet(0x0800, ipv4(47, gre(0x880B, b"\x00\x21" + INNER4, 0x3081, bytes(12)))), 4, 47, 443, 80,
    ),
    "gre routed": (ethernet(0x0800, ipv4(47, gre(0x0800, INNER4, 0x4000, bytes(4)))), 4, 47, 0, 0),
    "gre cut": (ethernet(0x0800, ipv4(47, gre(0x0800, INNER4)[:20])), 4, 47, 0, 0),
    "labels cut": (ethernet(0x8847, mpls(16, 17, payload=b"")[:6]), 0, 0, 0, 0),
    "fragment of a tunnel": (ethernet(0x0800, ipv4(4, INNER4, flags=0x2000)), 4, 4, 0, 0),
    "200 layers": (ethernet(0x8847, mpls(*range(16, 116), payload=INNER4), vlans=[0x8100] * 99), 4, 6, 443, 80),
}


def test_frames_within_frames():
    frames = [frame for frame, *_ in NESTED.values()]
    lengths = np.array([len(frame) for frame in frames])
    data = np.frombuffer(b"".join(frames), dtype=np.uint8)
    found = captures.decode_records(data, np.cumsum(lengths) - lengths, lengths, 1)
    columns = ("ip_version", "protocol", "src_port", "dst_port")
    for i, (name, (_, *expected)) in enumerate(NESTED.items()):
        assert [int(found[c][i]) for c in columns] == expected, name
        assert found["bad"][i] == (expected[0] == 0), name


def test_nested_frames_of_a_file_are_packets(spark, tmp_path):
    rows = read(spark, tmp_path / "in", "a.pcap", capture([frame for frame, *_ in NESTED.values()]))
    seen = [(r.ip_version, r.protocol, r.src_port, r.dst_port) for r in rows]
    assert seen == [tuple(expected) for _, *expected in NESTED.values()]


def section(order):
    return block(order, 0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order, link_type, resolution=None, offset=0, snap=65535):
    options = b""
    if resolution is not None:
        options += struct.pack(f"{order}HHB3x", 9, 1, resolution)
    if offset:
        options += struct.pack(f"{order}HHq", 14, 8, offset)
    options += bytes(4) if options else b""
    return block(order, 1, struct.pack(f"{order}HHI", link_type, 0, snap) + options)


def enhanced(order, number, ticks, frame):
    size = len(frame)
    head = struct.pack(f"{order}IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, size, size + 100)
    return block(order, 6, head + frame)


def test_blocks_of_two_sections_and_clocks(spark, tmp_path):
    frame, raw = ethernet(0x0800, ipv4(6, tcp(443, 80))), ipv4(17, udp(53, 99))
    ticks = TIME * 1_000_000 + 5
    content = b"".join([
        section("<"), interface("<", 1), interface("<", 101, 9, offset=3),
        enhanced("<", 0, ticks, frame),
        enhanced("<", 1, TIME * 10**9 + 7, raw),
        enhanced("<", 2, ticks, frame),  # no such interface
        block("<", 5, bytes(12)),  # statistics
        section(">"), interface(">", 101, 0x80 | 10), interface(">", 147),
        enhanced(">", 0, TIME << 10 | 512, raw),
        enhanced(">", 1, ticks, frame),  # an unknown kind of frame
        block(">", 3, struct.pack(">I", len(raw)) + raw),
        block(">", 2, struct.pack(">HHQII", 0, 0, TIME << 10, len(raw), len(raw)) + raw),
    ])
    rows = read(spark, tmp_path / "in", "a.pcapng", content)
    seen = sorted((r.ts_nanos or 0, r.src_port, r.length) for r in rows if not r.bad)
    second = TIME * 10**9
    assert seen == [
        (0, 53, 28), (second, 53, 28), (second + 5000, 443, len(frame) + 100),
        (second + 5 * 10**8, 53, 128), (second + 3 * 10**9 + 7, 53, 128),
    ]
    assert sum(r.bad for r in rows) == 2


def test_split_and_damaged_blocks(spark, tmp_path):
    parts, ports = [], []
    random = Random(2)
    for part in range(4):
        order = "<>"[part % 2]
        parts += [section(order), interface(order, 1, 9 if part == 2 else 6)]
        for i in range(600):
            frame = ethernet(0x0800, ipv4(6, tcp(part * 600 + i + 1, 80) + bytes(random.randint(0, 99))))
            one = enhanced(order, 0, TIME * 10 ** (9 if part == 2 else 6) + i, frame)
            if random.random() < 0.05:
                one = one[:4] + b"\xff\xff" + one[6:]
            else:
                ports.append(part * 600 + i + 1)
            if random.random() < 0.02:
                one += random.randbytes(random.randint(1, 50))
            parts.append(one)
    rows = read(spark, tmp_path / "in", "a.pcapng", b"".join(parts))
    assert sorted(r.src_port for r in rows if not r.bad) == ports
    assert all(TIME <= r.ts_nanos // 10**9 < TIME + 1 for r in rows if not r.bad)
    split = capture_records(spark, str(tmp_path / "in"), split_bytes=30_000)
    assert split.rdd.getNumPartitions() > 8
    whole = sorted(map(tuple, rows), key=repr)
    assert sorted(map(tuple, split.select(*rows[0].__fields__).collect()), key=repr) == whole


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("magic, nanos", [(0xA1B2C3D4, 123_000), (0xA1B23C4D, 123)])
def test_byte_orders_and_fractions(spark, tmp_path, order, magic, nanos):
    content = capture([ethernet(0x0800, ipv4(6, tcp(443, 80)))], order, magic)
    (row,) = read(spark, tmp_path / "in", "a.pcap", content)
    assert (row.ts_nanos, row.src_port) == (TIME * 10**9 + nanos, 443)


@pytest.mark.parametrize(
    "link_type, frame",
    [
        (101, ipv4(6, tcp(443, 80))),
        (101, ipv6(6, tcp(443, 80))),
        (113, bytes(14) + struct.pack(">H", 0x0800) + ipv4(6, tcp(443, 80))),
    ],
)
def test_link_types(spark, tmp_path, link_type, frame):
    (row,) = read(spark, tmp_path / "in", "a.pcap", capture([frame], link_type=link_type))
    assert (row.src_port, row.bad) == (443, False)


def test_cut_off_record_is_bad(spark, tmp_path):
    frames = [ethernet(0x0800, ipv4(6, tcp(port, 80))) for port in (1, 2)]
    rows = read(spark, tmp_path / "in", "a.pcap", capture(frames)[:-5])
    assert sorted((row.bad, row.src_port) for row in rows) == [(False, 1), (True, None)]


def test_reading_goes_on_behind_a_broken_record(spark, tmp_path):
    frames = [ethernet(0x0800, ipv4(6, tcp(port, 80))) for port in range(1, 1011)]
    content, record = capture(frames), 16 + len(frames[0])
    at = 24 + 10 * record
    broken = struct.pack("<IIII", TIME, 0, 0xFFFFFFF0, 60) + b"junk" * 5
    rows = read(spark, tmp_path / "in", "a.pcap", content[:at] + broken + content[at:])
    assert sorted(row.src_port for row in rows if not row.bad) == list(range(1, 1011))
    assert sum(row.bad for row in rows) == 1
    # Nothing plausible behind it: the rest is one damaged record.
    rows = read(spark, tmp_path / "end", "a.pcap", content[:at] + broken)
    assert sum(row.bad for row in rows) == 1 and len(rows) == 11


def test_an_ip_header_before_a_broken_record_is_no_record(spark, tmp_path):
    # Its length, lifetime and protocol read as a time and as a size that ends at a record; the
    # source address would be the length.
    frames = [ethernet(0x0800, ipv4(6, tcp(port, 80))) for port in range(1, 61)]
    frames[9] = frames[9][:16] + struct.pack(">H", 101) + frames[9][18:]
    content, record = capture(frames), 16 + len(frames[0])
    at = 24 + 10 * record
    broken = struct.pack("<IIII", 1, 0, 0xFFFFFFF0, 60) + b"junk" * 5
    assert (30 + 16 + 0x0640 - len(broken)) % record == 0
    rows = read(spark, tmp_path / "in", "a.pcap", content[:at] + broken + content[at:])
    assert sorted(row.src_port for row in rows if not row.bad) == list(range(1, 61))
    assert sum(row.bad for row in rows) == 1


def damage(random, frames):
    """A capture with damages at random places, and the ports of the records left whole."""
    records, kinds = [], []
    for i, frame in enumerate(frames):
        head = struct.pack("<IIII", TIME + i, 9, len(frame), len(frame) + random.choice([0, 100]))
        record, kind = head + frame, random.choice(["none"] * 6 + ["size", "junk", "cut", "long"])
        if kind == "size":  # a length that no packet has
            record = record[:8] + struct.pack("<I", 0xFFFFFFF0) + record[12:]
        elif kind == "cut":  # bytes are missing at the end
            record = record[:-5]
        elif kind == "junk":  # something before a whole record
            record = random.randbytes(random.randint(1, 3000)) + record
        records.append(record)
        kinds.append(kind)
    for i, kind in enumerate(kinds):
        if kind == "long" and i + 9 < len(records):  # a length that ends amid a later record
            size = sum(map(len, records[i : i + 8])) + 40 - 16
            records[i] = records[i][:8] + struct.pack("<II", size, size) + records[i][16:]
    whole = [i + 1 for i, kind in enumerate(kinds) if kind in ("none", "junk")]
    return capture([]) + b"".join(records), whole


@pytest.mark.parametrize("seed", range(6))
def test_damages_cost_only_the_damaged_records(spark, tmp_path, seed):
    random = Random(seed)
    frames = [
        ethernet(0x0800, ipv4(6, tcp(port, 80) + random.randbytes(random.randint(0, 300))))
        for port in range(1, 2001)
    ]
    content, whole = damage(random, frames)
    rows = read(spark, tmp_path / "in", "a.pcap", content)
    found = [row.src_port for row in rows if not row.bad]
    assert len(found) == len(set(found))
    # A record with bytes missing can look whole, but no whole one is lost.
    assert set(whole) <= set(found)
    split = capture_records(spark, str(tmp_path / "in"), split_bytes=20_000).orderBy("ts_nanos")
    assert [tuple(r) for r in split.collect()] == [tuple(r) for r in rows]


def test_a_damage_in_every_split_leaves_one_range_each(spark, tmp_path):
    frames = [ethernet(0x0800, ipv4(6, tcp(port, 80))) for port in range(1, 10001)]
    content = capture(frames)
    record, broken = 16 + len(frames[0]), struct.pack("<IIII", 1, 0, 0xFFFFFFF0, 60) + b"junk" * 5
    cuts = [24 + record * n for n in range(0, 10001, 500)]
    content = content[:24] + broken.join(content[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(content)
    ranges = capture_ranges(spark, str(folder), 50_000).orderBy("start").collect()
    assert len(ranges) == -(-len(content) // 50_000)
    assert [r.start for r in ranges[1:]] == [r.stop for r in ranges[:-1]]
    records = capture_records(spark, str(folder), 50_000)
    assert records.rdd.getNumPartitions() == len(ranges)
    quality = ingest_quality(records).first()
    assert (quality.total, quality.failed) == (10_019, 19)


def test_damage_is_passed_in_linear_time(tmp_path):
    """Twice the damaged bytes take about twice the time, not four times."""
    frame = ethernet(0x0800, ipv4(6, tcp(1, 80)))
    one = capture([frame])[24:] + struct.pack("<IIII", 1, 0, 0xFFFFFFF0, 60)

    def seconds(count):
        path = tmp_path / str(count)
        path.write_bytes(capture([]) + one * count)
        with captures._Capture(str(path)) as opened:
            started = time.perf_counter()
            found = sum(len(x[2]) for x in captures._walk(opened, 24, opened.size))
            assert found == count
            return time.perf_counter() - started

    seconds(100)
    assert seconds(8_000) < 3 * seconds(4_000) + 0.5


def test_first_record_damaged_and_clocks_that_jump(spark, tmp_path):
    frames = [ethernet(0x0800, ipv4(6, tcp(port, 80))) for port in range(1, 51)]
    content = bytearray(capture(frames))
    content[24 : 24 + 16] = b"\xff" * 16
    rows = read(spark, tmp_path / "in", "a.pcap", bytes(content))
    assert sorted(row.src_port for row in rows if not row.bad) == list(range(2, 51))
    assert sum(row.bad for row in rows) == 1
    # Packets in a row need no credible clock.
    content = bytearray(capture(frames))
    record = 16 + len(frames[0])
    for i in range(10, 20):
        content[24 + i * record : 28 + i * record] = bytes(4)
    rows = read(spark, tmp_path / "clock", "a.pcap", bytes(content))
    assert sorted(row.src_port for row in rows) == list(range(1, 51))


def test_any_number_of_vlan_tags(spark, tmp_path):
    frames = [
        ethernet(0x0800, ipv4(6, tcp(n, 80)), vlans=[0x88A8] * n + [0x8100]) for n in range(5)
    ]
    rows = read(spark, tmp_path / "in", "a.pcap", capture(frames))
    assert [(row.src_port, row.bad) for row in rows] == [(n, False) for n in range(5)]


def test_other_files_and_odd_names_do_not_stop_the_job(spark, tmp_path):
    frames = [ethernet(0x0800, ipv4(6, tcp(443, 80)))]
    read(spark, tmp_path / "in", "no capture.txt", b"text" * 20)
    read(spark, tmp_path / "in", "empty", b"")
    rows = read(spark, tmp_path / "in", "a b%20c#1.pcap", capture(frames))
    # An empty file holds no record.
    assert sorted(row.bad for row in rows) == [False, True]
    assert [row.file.rsplit("/", 1)[1] for row in rows if row.bad] == ["no capture.txt"]


def test_pieces_and_splits_do_not_change_the_result(spark, tmp_path, monkeypatch):
    """One large file: read whole, in small pieces, and in many splits."""
    packets = synthetic_packets(spark, 20_000, seed=3).coalesce(1)
    folder = str(tmp_path / "big")
    assert write_captures(packets, folder).first().packets == 20_000
    whole = pcap_scan(spark, folder)
    monkeypatch.setattr(captures, "PIECE", 10_000)
    split = pcap_scan(spark, folder, split_bytes=100_000)
    ranges = capture_ranges(spark, folder, 100_000).orderBy("start").collect()
    # The last split holds less than a record.
    assert len(ranges) == 14
    assert [r.start for r in ranges[1:]] == [r.stop for r in ranges[:-1]]
    assert whole.count() == split.count() == 20_000
    assert whole.exceptAll(split).count() == 0
    columns = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length"]
    assert packets.select(columns).exceptAll(split.select(columns)).count() == 0


def test_wrong_guesses_are_found_and_repaired(spark, tmp_path):
    """Payloads full of convincing record headers must not shift the ranges."""
    fake = struct.pack("<IIII", TIME, 1, 24, 24) + bytes(24)
    frames = [ethernet(0x0800, ipv4(17, udp(i % 60000, 53) + fake * 30)) for i in range(3000)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(capture(frames))
    whole = pcap_scan(spark, str(folder))
    split = pcap_scan(spark, str(folder), split_bytes=300_000)
    assert whole.count() == split.count() == 3000
    assert whole.exceptAll(split).count() == 0
    reached = capture_ranges(spark, str(folder), 300_000).agg(F.max("stop"), F.min("start")).first()
    assert reached[1] == 24


def test_written_packets_come_back(spark, sf_dir, tmp_path):
    packets = lineitem_packets(spark, sf_dir).repartition(3)
    folder = str(tmp_path / "out")
    assert write_captures(packets, folder).agg(F.sum("packets")).first()[0] == packets.count()
    columns = ["ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length"]
    assert packets.select(columns).exceptAll(pcap_scan(spark, folder).select(columns)).count() == 0


def test_synthetic_packets_do_not_depend_on_partitioning(spark):
    once = synthetic_packets(spark, 5000, seed=1)
    again = synthetic_packets(spark.range(5000).repartition(7), seed=1)
    assert once.exceptAll(again).count() == 0
    assert once.exceptAll(synthetic_packets(spark, 5000, seed=2)).count() == 5000
    bounds = once.agg(F.min("src_port"), F.max("dst_port"), F.min("length"), F.max("length")).first()
    assert bounds[0] >= 1024 and bounds[1] <= 65534
    assert (bounds[2], bounds[3]) == (104, 1503)
