"""Capture files (pcap and pcapng) read as packet tables.

Spark lists the folder and spreads byte ranges of the files over tasks. A task
streams its ranges in fixed-size pieces and decodes each piece with array
operations, so memory does not grow with a file. Files larger than a split are read
by many tasks at once, although the format has no marks to split at: see
`capture_ranges`. Damage costs the damaged records alone: see `_walk`. Addresses leave Python as numbers and bytes; Spark formats them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.addresses import canonical_ip_sql
from flowloom.model import TCP, UDP
from flowloom.session import shared_dir
from flowloom.sources import pcapng

RECORD_SCHEMA = (
    "file string, ts_nanos bigint, ip_version int, src_v4 bigint, dst_v4 bigint, "
    "src_v6 binary, dst_v6 binary, src_port int, dst_port int, protocol int, "
    "length bigint, bad boolean"
)

# Bytes of a file held at a time, bytes read at first, and bytes of a file for one task.
PIECE = 8 << 20
FIRST_PIECE = 32 << 10
SPLIT_BYTES = 256 << 20
# Beyond this many ranges, a task reads several in turn.
MOST_TASKS = 100_000

TEN_YEARS = 10 * 366 * 86400

# File magics (byte order, nanoseconds per fraction unit), link types
# with the offset of their ether type (None: bare IP), and protocol numbers.
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\xc3\xd4": (">", 1000),
    b"\x4d\x3c\xb2\xa1": ("<", 1),
    b"\xa1\xb2\x3c\x4d": (">", 1),
}
ETHERNET, RAW_IP, LINUX_COOKED = 1, 101, 113
IPV4_TYPE, IPV6_TYPE, BRIDGED_TYPE, PPP_TYPE = 0x0800, 0x86DD, 0x6558, 0x880B
VLAN_TYPES = (0x8100, 0x88A8)
MPLS_TYPES = (0x8847, 0x8848)
PPPOE_TYPE = 0x8864
PPP_IPV4, PPP_IPV6, PPP_MPLS = 0x0021, 0x0057, 0x0281
HOP_BY_HOP, ROUTING, DESTINATION = 0, 43, 60
IPV4_WITHIN, IPV6_WITHIN, GRE_WITHIN = 4, 41, 47
# Layers of a frame: an Ethernet header, the type of what follows, and what follows.
FRAME, TYPE, LABELS, SESSION, PPP, GRE, ANY_IP, IP4, IP6 = range(1, 10)
FIRST_LAYER = {
    ETHERNET: (FRAME, 0),
    LINUX_COOKED: (TYPE, 14),
    276: (TYPE, 0),
    9: (PPP, 0),
    51: (SESSION, 0),
    **dict.fromkeys((RAW_IP, 12, 228, 229), (ANY_IP, 0)),
}
FILE_HEADER_BYTES, RECORD_HEADER_BYTES = 24, 16
LONGEST_PACKET = 262144

# A record that starts before a place ends less than this behind it.
REACH = LONGEST_PACKET + RECORD_HEADER_BYTES
# Bytes looked at for records behind damage, and headers in a row that make one likely.
WINDOW = 4 << 20
CHAIN = 3
# Bytes of a frame that tell whether it is an IP packet.
TELLING = 54


def decode_records(data, starts, kept, link_type: int) -> dict:
    """Packet fields of the records of one piece, as arrays.

    `data` is the piece as bytes, `starts` where each packet begins, `kept` how many
    of its bytes were captured. Records that hold no whole IP header are bad.

    Layers are walked until nothing known follows, one step of all records at a time: VLAN
    tags, MPLS labels, PPPoE and PPP, IP within IP, GRE. Addresses and protocol are those of
    the outermost IPv4 header or, without any, of the outermost IPv6 header; ports are those
    of the TCP or UDP header at the end.
    """
    import numpy as np

    n = len(starts)
    ends = starts + kept
    first, skipped = FIRST_LAYER[link_type]
    layer, place = np.full(n, first, dtype=np.int64), starts + skipped
    outer = {IP4: np.full(n, -1, dtype=np.int64), IP6: np.full(n, -1, dtype=np.int64)}
    ports = np.full(n, -1, dtype=np.int64)

    def number(rows, places, size: int):
        """Big-endian numbers of `size` bytes of records, 0 beyond their ends."""
        value = np.zeros(len(rows), dtype=np.int64)
        there = places + size <= ends[rows]
        for step in range(size):
            value[there] = (value[there] << 8) | data[places[there] + step]
        return value

    def chosen(values, layers: dict):
        """The layer of each value; 0, which ends a walk, where it is none of `layers`."""
        out = np.zeros(len(values), dtype=np.int64)
        for value, known in layers.items():
            out[values == value] = known
        return out

    by_type = {
        IPV4_TYPE: IP4, IPV6_TYPE: IP6, BRIDGED_TYPE: FRAME, PPP_TYPE: PPP, PPPOE_TYPE: SESSION,
        **dict.fromkeys(VLAN_TYPES, TYPE), **dict.fromkeys(MPLS_TYPES, LABELS),
    }
    by_version = {4: IP4, 6: IP6}

    def transport(rows, protocol, places):
        """Ports of what is behind an IP header, or the layer within it."""
        needed = np.where(protocol == TCP, 20, 8)
        ported = np.isin(protocol, (TCP, UDP)) & (places + needed <= ends[rows])
        ports[rows[ported]] = places[ported]
        within = {IPV4_WITHIN: IP4, IPV6_WITHIN: IP6, GRE_WITHIN: GRE}
        layer[rows], place[rows] = chosen(protocol, within), places

    def step(kind: int, rows) -> None:
        """Move records whose layer is `kind` on to the next one."""
        at = place[rows]
        if kind == FRAME:
            layer[rows], place[rows] = TYPE, at + 12
        elif kind == TYPE:
            ether_type = number(rows, at, 2)
            layer[rows] = chosen(ether_type, by_type)
            # A tag is followed by the type of what it tags.
            place[rows] = at + np.where(np.isin(ether_type, VLAN_TYPES), 4, 2)
        elif kind == LABELS:
            last = number(rows, at + 2, 1) & 1 == 1
            version = number(rows, at + 4, 1) >> 4
            inner = np.where(np.isin(version, (4, 6)), chosen(version, by_version), FRAME)
            there = at + 4 <= ends[rows]
            layer[rows] = np.where(there, np.where(last, inner, LABELS), 0)
            place[rows] = at + 4
        elif kind == SESSION:
            layer[rows] = np.where(number(rows, at, 2) == 0x1100, PPP, 0)
            place[rows] = at + 6
        elif kind == PPP:
            # Odd protocols may be written as one byte.
            short = number(rows, at, 1) & 1 == 1
            protocol = np.where(short, number(rows, at, 1), number(rows, at, 2))
            known = {PPP_IPV4: IP4, PPP_IPV6: IP6, PPP_MPLS: LABELS}
            layer[rows], place[rows] = chosen(protocol, known), at + np.where(short, 1, 2)
        elif kind == GRE:
            flags = number(rows, at, 2)
            size = 4 + sum(4 * ((flags & bit) != 0) for bit in (0x8000, 0x2000, 0x1000))
            # Version 1 carries PPP and may acknowledge; routed headers are not walked.
            size += 4 * ((flags & 0x0087) == 0x0081)
            known = chosen(number(rows, at + 2, 2), by_type)
            layer[rows] = np.where((flags & 0x4000) == 0, known, 0)
            place[rows] = at + size
            tagged = layer[rows] == TYPE
            place[rows[tagged]] += 2
        elif kind == ANY_IP:
            layer[rows] = chosen(number(rows, at, 1) >> 4, by_version)
        elif kind == IP4:
            size = (number(rows, at, 1) & 15) * 4
            whole = (at + 20 <= ends[rows]) & (size >= 20) & (at + size <= ends[rows])
            layer[rows[~whole]] = 0
            rows, at, size = rows[whole], at[whole], size[whole]
            new = outer[IP4][rows] < 0
            outer[IP4][rows[new]] = at[new]
            # Fragments carry no ports of their own.
            fragment = (number(rows, at + 6, 2) & 0x3FFF) != 0
            transport(rows, np.where(fragment, -1, number(rows, at + 9, 1)), at + size)
        else:
            whole = at + 40 <= ends[rows]
            layer[rows[~whole]] = 0
            rows, at = rows[whole], at[whole]
            new = outer[IP6][rows] < 0
            outer[IP6][rows[new]] = at[new]
            following, at = number(rows, at + 6, 1), at + 40
            while True:
                extended = np.isin(following, (HOP_BY_HOP, ROUTING, DESTINATION))
                extended &= at + 8 <= ends[rows]
                if not extended.any():
                    break
                size = (number(rows, at + 1, 1) + 1) * 8
                following = np.where(extended, number(rows, at, 1), following)
                at = np.where(extended, at + size, at)
            transport(rows, following, at)

    while len(active := np.flatnonzero(layer)):
        for kind in np.unique(layer[active]).tolist():
            step(kind, active[layer[active] == kind])

    is_v4 = outer[IP4] >= 0
    is_v6 = ~is_v4 & (outer[IP6] >= 0)
    ip = np.where(is_v4, outer[IP4], outer[IP6])
    every, four, six = np.arange(n), np.flatnonzero(is_v4), np.flatnonzero(is_v6)
    protocol = np.zeros(n, dtype=np.int64)
    protocol[four], protocol[six] = number(four, ip[four] + 9, 1), number(six, ip[six] + 6, 1)

    def address(offset: int):
        out = np.zeros(n, dtype=np.int64)
        out[four] = number(four, ip[four] + offset, 4)
        return out

    def port(offset: int):
        found = number(every, np.where(ports >= 0, ports + offset, ends), 2)
        return found.astype(np.int32)

    def v6_bytes(offset: int) -> list:
        places = ip + offset
        return [bytes(data[p : p + 16]) if v6 else None for p, v6 in zip(places, is_v6)]

    has_v6 = bool(is_v6.any())
    return {
        "ip_version": np.where(is_v4, 4, np.where(is_v6, 6, 0)).astype(np.int32),
        "is_v4": is_v4,
        "src_v4": address(12),
        "dst_v4": address(16),
        "src_v6": v6_bytes(8) if has_v6 else [None] * n,
        "dst_v6": v6_bytes(24) if has_v6 else [None] * n,
        "src_port": port(0),
        "dst_port": port(2),
        "protocol": protocol.astype(np.int32),
        "bad": ~(is_v4 | is_v6),
    }


class _Capture:
    """An open capture file with what its header says."""

    def __init__(self, path: str):
        files, name = _file_system(path)
        self.stream = files.open_input_file(name)
        self.size = self.stream.size()
        head = self.stream.read(FILE_HEADER_BYTES)
        # A file of blocks, read by the functions of `pcapng`.
        self.blocks = head[:4] == pcapng.MAGIC and pcapng.block_at(self.read(0, pcapng.LONGEST_BLOCK), 0)
        self.readable = len(head) == FILE_HEADER_BYTES and head[:4] in MAGICS
        if not self.readable:
            return
        self.order, self.fraction = MAGICS[head[:4]]
        word = "little" if self.order == "<" else "big"
        self.link_type = int.from_bytes(head[20:24], word) & 0xFFFF
        self.readable = self.link_type in FIRST_LAYER
        self._window: tuple[int, object] = (-1, None)
        self.second = self._first_second()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()

    def read(self, begin: int, count: int) -> bytes:
        self.stream.seek(begin)
        return self.stream.read(count)

    def _first_second(self) -> int:
        """A clock that those of other records are near; 0 if there is none to go by.

        It is that of the first record or, where this leads nowhere, of the first one in the
        file that is an IP packet, in a chain of records if there are such.
        """
        import struct

        first = self.read(FILE_HEADER_BYTES, RECORD_HEADER_BYTES)
        if len(first) < RECORD_HEADER_BYTES:
            return 0
        second, _, kept, _ = struct.unpack(f"{self.order}IIII", first)
        following = FILE_HEADER_BYTES + RECORD_HEADER_BYTES + kept
        if following == self.size:
            return second
        after = self.read(following, 4) if following + 4 <= self.size else b""
        if after and abs(struct.unpack(f"{self.order}I", after)[0] - second) < TEN_YEARS:
            return second
        self.second = 0
        sure = self._records_in(0, surely=True)
        found = self.read(int(sure[0]), 4) if len(sure) else bytes(4)
        return struct.unpack(f"{self.order}I", found)[0]

    def judge(self, seconds, fractions, kept, lengths) -> tuple:
        """(sane, credible): headers that may be those of records; those in time as well."""
        import numpy as np

        sane = (kept <= LONGEST_PACKET) & (fractions * self.fraction < 1_000_000_000) & (lengths > 0)
        # Some writers leave the link header out of the length. No packet is longer than the
        # longest that can be kept, while an address read as a length nearly always is.
        credible = sane & (kept <= lengths + TELLING) & (lengths <= LONGEST_PACKET)
        if self.second > TEN_YEARS:
            credible &= np.abs(seconds - self.second) < TEN_YEARS
        return sane, credible

    def headers(self, data) -> tuple:
        """(positions, captured bytes, credible) of the sane headers at any byte of `data`."""
        import numpy as np

        count = len(data) - RECORD_HEADER_BYTES + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        words = np.empty(len(data) - 3, dtype=f"{self.order}u4")
        for k in range(4):
            words[k::4] = np.frombuffer(data, words.dtype, (len(data) - k) // 4, k)
        at = np.flatnonzero(words[8 : 8 + count] <= LONGEST_PACKET)
        seconds, fractions, kept, lengths = (words[at + k].astype(np.int64) for k in (0, 4, 8, 12))
        sane, credible = self.judge(seconds, fractions, kept, lengths)
        return at[sane], kept[sane], credible[sane]

    def record_after(self, position: int) -> int:
        """The first position from `position` on where a record is taken to start.

        Without one, the end of the file. Windows of a file are looked at once each while
        the questions move forward.
        """
        import numpy as np

        number = position // WINDOW
        while number * WINDOW < self.size:
            if self._window[0] != number:
                self._window = number, self._records_in(number * WINDOW)
            found = self._window[1]
            i = int(np.searchsorted(found, position))
            if i < len(found):
                return int(found[i])
            number += 1
        return self.size

    def _records_in(self, begin: int, surely: bool = False):
        """Positions in a window where records are taken to start.

        Such a header is credible, and what it announces has the shape of an IP packet or
        ends with the file, or a chain of `CHAIN` headers starts there. Of a record that the
        end of the file cuts off too early to tell, the header counts if no other one starts
        within it.
        """
        import numpy as np

        data = np.frombuffer(
            self.read(begin, WINDOW + CHAIN * (LONGEST_PACKET + RECORD_HEADER_BYTES)), np.uint8
        )
        at, kept, credible = self.headers(data)
        at, kept = at[credible & (kept > 0)], kept[credible & (kept > 0)]
        following = at + RECORD_HEADER_BYTES + kept
        i = np.minimum(np.searchsorted(at, following), max(len(at) - 1, 0))
        linked = at[i] == following
        reach = np.ones(len(at), dtype=np.int64)
        for _ in range(CHAIN - 1):
            reach = 1 + np.where(linked, reach[i], 0)
        chained = (reach >= CHAIN) | (begin + following == self.size)
        cut = begin + following > self.size
        there = np.minimum(kept, len(data) - at - RECORD_HEADER_BYTES)
        tried = np.flatnonzero((cut | (following <= len(data))) & (at < WINDOW))
        shape = decode_records(data, at[tried] + RECORD_HEADER_BYTES, there[tried], self.link_type)
        worth = chained.astype(np.int64)
        worth[tried] += 2 * ~shape["bad"]
        early = cut & (self.second > 0) & (there < TELLING) & (np.diff(at, append=self.size) >= RECORD_HEADER_BYTES)
        taken = (worth > 0) | early
        # Bytes just beside a header may look like one; the better one counts.
        for k in range(1, min(RECORD_HEADER_BYTES, len(at))):
            beside = at[k:] - at[:-k] < RECORD_HEADER_BYTES
            if not beside.any():
                break
            taken[k:] &= ~(beside & (worth[:-k] > worth[k:]))
            taken[:-k] &= ~(beside & (worth[k:] > worth[:-k]))
        if surely:
            taken = (worth == worth.max(initial=2)) & (at < WINDOW)
        return begin + at[taken & (at < WINDOW)]


def _walk(capture: _Capture, begin: int, stop: int, split: int | None = None) -> Iterator[tuple]:
    """(bytes, their place, record positions in them, damaged records, position after them).

    Starts at `begin` and ends at the first record at or after `stop`, or at the end of the
    file. With `split`, the end lies no farther behind a multiple of it than one record
    reaches, so that the task that reads from there on knows the place.

    A header that is not sane, or stands alone and has no packet behind it, is a damaged
    record; reading goes on where the next record is taken to start. If a record
    leads to such a header although another one starts within it, its length is wrong: it is
    damaged, and reading goes on within it. A record that the end of the file cuts off is
    damaged too. Whatever the lengths say, about a piece and a few packets are held.
    """
    import struct

    import numpy as np

    captured_bytes = struct.Struct(f"{capture.order}I").unpack_from
    held, held_at, position, more = b"", begin, begin, True
    piece = min(FIRST_PIECE, PIECE)

    def far(place: int) -> bool:
        return split is not None and place % split >= REACH

    def first_not(flags) -> int:
        return len(flags) if flags.all() else int(np.argmin(flags))

    while position < capture.size:
        if position >= stop and far(position):
            stop = (position // split + 1) * split
        if more or position >= held_at + len(held):
            held, held_at = held[position - held_at :], position
            held += capture.read(held_at + len(held), piece)
            piece = min(2 * piece, PIECE)
        more, ended = False, held_at + len(held) >= capture.size
        at, place, past = [], position - held_at, 0
        while place + RECORD_HEADER_BYTES <= len(held) and past <= CHAIN:
            at.append(place)
            past += held_at + place >= stop
            size = captured_bytes(held, place + 8)[0]
            if size > LONGEST_PACKET or place + RECORD_HEADER_BYTES + size > len(held):
                break
            place += RECORD_HEADER_BYTES + size
        # Where a record is not held in full, or there is no room for one more header.
        cut = bool(at) and at[-1] == place
        complete = not cut and held_at + place == capture.size
        at = np.array(at, dtype=np.int64)
        header = np.frombuffer(held, np.uint8)[at[:, None] + np.arange(RECORD_HEADER_BYTES)]
        sane, credible = capture.judge(*header.view(f"{capture.order}u4").astype(np.int64).T)

        # Followed by nothing sane, a header in time counts if a packet is behind it.
        shaped = np.zeros(len(at), dtype=bool)
        alone = np.flatnonzero(credible[:-1] & ~sane[1:])
        if len(alone):
            _, _, kept, _ = header[alone].view(f"{capture.order}u4").astype(np.int64).T
            packets = decode_records(
                np.frombuffer(held, np.uint8), at[alone] + RECORD_HEADER_BYTES, kept, capture.link_type
            )
            shaped[alone] = ~packets["bad"]

        def counted(tail: bool):
            """Headers of records, if `tail` says whether a sane one is behind the last."""
            one, two = np.append(sane[1:], tail), np.append(credible[1:], tail)
            return shaped | (sane & one & (credible | two | np.append(one[1:], tail)))

        bad = first_not(counted(complete if ended else True))
        unsure = first_not(counted(complete if ended else False))
        goal = int(np.searchsorted(at, stop - held_at))
        if goal < min(bad, unsure):
            position = held_at + int(at[goal])
            yield held, held_at, at[:goal], 0, position
            if far(position):
                continue
            return
        if not ended and (unsure < bad or bad == len(at)):
            # More bytes are needed. The last record is told again, as it is not known yet
            # what follows it.
            more = True
            known = min(unsure, len(at) - cut)
            if known > 1:
                position = held_at + int(at[known - 1])
                yield held, held_at, at[: known - 1], 0, position
            continue
        if bad == len(at) and complete:
            yield held, held_at, at, 0, capture.size
            return
        if bad == len(at) and cut:
            position = capture.record_after(held_at + place + 1)
            yield held, held_at, at[:-1], 1, position
            continue
        broken = held_at + (int(at[bad]) if bad < len(at) else place)
        at = at[:bad]
        if len(at):
            found = capture.record_after(held_at + int(at[-1]) + 1)
            if found < broken:
                yield held, held_at, at[:-1], 1, found
                position = found
                continue
        position = capture.record_after(broken + 1)
        yield held, held_at, at, 1, position


def _file_system(path: str):
    """Arrow's file system of a path and the path there; without a scheme it is local."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme or scheme == "file":
        local = rest if scheme == "file" else path
        return fs.LocalFileSystem(), f"/{local.lstrip('/')}" if scheme == "file" else local
    # Spark names files without escapes.
    return fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}:{quote(rest)}")


def _links(capture: _Capture, first: int, last: int, split: int) -> dict[int, list[int]]:
    """Starts of records near `first` by where a walk from them through `last` ends.

    Every position counts at which a walk from before may end, so the true one is among
    them. Walks that meet go on as one.
    """
    import numpy as np

    if not first:
        *_, end = [FILE_HEADER_BYTES, *(x[-1] for x in _walk(capture, FILE_HEADER_BYTES, last, split))]
        return {end: [FILE_HEADER_BYTES]}
    near = min(last, first + REACH)
    data = np.frombuffer(
        capture.read(first, near - first + 2 * REACH + RECORD_HEADER_BYTES), np.uint8
    )
    at, kept, credible = capture.headers(data)
    following = at + RECORD_HEADER_BYTES + kept
    # A walk ends only at headers that count, see `_walk`.
    i = np.minimum(np.searchsorted(at, following), max(len(at) - 1, 0))
    ends_file = first + following >= capture.size
    linked = (at[i] == following) | ends_file
    counts = linked & (credible | credible[i] | linked[i] | ends_file)
    alone = np.flatnonzero(credible & ~linked & (following <= len(data)))
    packets = decode_records(data, at[alone] + RECORD_HEADER_BYTES, kept[alone], capture.link_type)
    counts[alone] = ~packets["bad"]
    counts &= at < near - first
    at, kept, credible = at[counts], kept[counts], credible[counts]
    walked: list[tuple] = []  # (positions of a walk, where it ends)

    def known(positions):
        """Where an earlier walk that holds one of the positions ends."""
        for places, end in walked:
            i = np.minimum(np.searchsorted(places, positions), len(places) - 1)
            if (places[i] == positions).any():
                return end
        return None

    # From the last one on; a record in time that is followed by such a one leads along.
    ends: dict[int, int] = {}
    trusted: dict[int, int] = {}
    for start, size, good in zip(
        (first + at)[::-1].tolist(), kept[::-1].tolist(), credible[::-1].tolist(), strict=True
    ):
        end = trusted.get(start + RECORD_HEADER_BYTES + size) if good else None
        if end is None:
            end = known(np.array([start]))
        if end is None:
            passed, met, end = [np.array([start])], None, start
            for _, held_at, records, _, end in _walk(capture, start, last, split):
                if len(records):
                    passed.append(held_at + records)
                    met = known(passed[-1])
                    if met is not None:
                        break
            if met is None:
                walked.append((np.unique(np.concatenate(passed)), end))
            else:
                end = met
        ends[start] = end
        if good:
            trusted[start] = end
    out: dict[int, list[int]] = {}
    for start, end in ends.items():
        out.setdefault(end, []).append(start)
    return out


LINKS = (
    "path string, first bigint, stop bigint, starts array<bigint>, "
    "marks array<struct<at: bigint, block: binary>>"
)
RANGES = "path string, start bigint, stop bigint, marks array<binary>"


def _batch(rows: list, schema):
    import pyarrow as pa

    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _locate(schema):
    """Where the records near the start of a byte range lead to, a row per end."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            columns = (batch.column(n).to_pylist() for n in ("path", "first", "last", "split"))
            for path, first, last, split in zip(*columns, strict=True):
                with _Capture(path) as capture:
                    if capture.blocks:
                        for stop, starts, marks in pcapng.block_links(capture, first, last, split):
                            marks = [{"at": at, "block": block} for at, block in marks]
                            rows.append((path, first, stop, starts, marks))
                    elif capture.readable:
                        for stop, starts in _links(capture, first, last, split).items():
                            rows.append((path, first, stop, starts, []))
                    elif not first:
                        rows.append((path, 0, capture.size, [FILE_HEADER_BYTES], []))
            if rows:
                yield _batch(rows, schema)

    return run


def _follow(schema):
    """The links that the first record of each file leads along, as record ranges.

    A range of blocks gets the marks of its section that came before it.
    """

    def run(batches: Iterator) -> Iterator:
        now, wanted, begin, marks = None, None, None, []
        names = ("path", "first", "stop", "starts", "marks", "next_first", "next_stop")
        for batch in batches:
            rows = []
            columns = (batch.column(n).to_pylist() for n in names)
            for path, first, stop, starts, found, next_first, next_stop in zip(*columns, strict=True):
                if path != now:
                    now, wanted, begin, marks = path, (0, stop), starts[0], []
                if (first, stop) == wanted:
                    rows.append((path, begin, stop, list(marks)))
                    for mark in found:
                        if mark["at"] >= begin:
                            if mark["block"][:4] == pcapng.MAGIC:
                                marks.clear()
                            marks.append(mark["block"])
                    wanted, begin = (next_first, next_stop), stop
            if rows:
                yield _batch(rows, schema)

    return run


def _block_records(path: str, capture: _Capture, start: int, stop: int, marks: list) -> Iterator:
    """Packets of a range of blocks, an Arrow batch per piece and kind of frame."""
    import numpy as np

    interfaces = pcapng.Interfaces(marks)
    for held, _, blocks, damaged, _ in pcapng.walk_blocks(capture, start, stop):
        packets = pcapng.packets_of(held, blocks, interfaces)
        unread = [p for p in packets if p[0] is None or p[0][0] not in FIRST_LAYER]
        if damaged + len(unread):
            yield _damaged(path, damaged + len(unread))
        groups: dict[tuple, list] = {}
        for packet in packets:
            if packet[0] is not None and packet[0][0] in FIRST_LAYER:
                groups.setdefault((packet[0], packet[1] is None), []).append(packet)
        data = np.frombuffer(held, dtype=np.uint8)
        for ((link_type, _, resolution, offset), timeless), group in groups.items():
            _, ticks, places, kept, lengths = zip(*group, strict=True)
            ticks = np.zeros(len(group)) if timeless else np.array(ticks, dtype=np.uint64)
            nanos = pcapng.nanos_of(ticks, resolution, offset)
            packet = decode_records(data, np.array(places), np.array(kept), link_type)
            yield _packet_batch(path, nanos, np.array(lengths), packet, timeless)


def _decode(batches: Iterator) -> Iterator:
    """Packets of the given record ranges, one Arrow batch per piece of a file."""
    import numpy as np

    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("path", "start", "stop", "marks"))
        for path, start, stop, marks in zip(*columns, strict=True):
            with _Capture(path) as capture:
                if capture.blocks:
                    yield from _block_records(path, capture, start, stop, marks)
                    continue
                if not capture.readable:
                    # One bad record stands for a file that is no capture.
                    if start in (0, FILE_HEADER_BYTES):
                        yield _damaged(path, 1)
                    continue
                for held, _, at, damaged, _ in _walk(capture, start or FILE_HEADER_BYTES, stop):
                    if damaged:
                        yield _damaged(path, damaged)
                    if not len(at):
                        continue
                    data = np.frombuffer(held, dtype=np.uint8)
                    header = data[at[:, None] + np.arange(RECORD_HEADER_BYTES)]
                    header = header.view(f"{capture.order}u4").astype(np.int64)
                    seconds, fractions, kept, lengths = header.T
                    packet = decode_records(
                        data, at + RECORD_HEADER_BYTES, kept, capture.link_type
                    )
                    nanos = seconds * 1_000_000_000 + fractions * capture.fraction
                    yield _packet_batch(path, nanos, lengths, packet)


def _packet_batch(path: str, nanos, lengths, packet: dict, timeless: bool = False):
    """Decoded packets as an Arrow batch; packets without a clock have no time."""
    import numpy as np
    import pyarrow as pa

    no_v4, count = ~packet["is_v4"], len(lengths)
    columns = [
        pa.array([path] * count, type=pa.string()),
        pa.array(nanos, mask=np.full(count, timeless)),
        pa.array(packet["ip_version"]),
        pa.array(packet["src_v4"], mask=no_v4),
        pa.array(packet["dst_v4"], mask=no_v4),
        pa.array(packet["src_v6"], type=pa.binary()),
        pa.array(packet["dst_v6"], type=pa.binary()),
        pa.array(packet["src_port"]),
        pa.array(packet["dst_port"]),
        pa.array(packet["protocol"]),
        pa.array(lengths),
        pa.array(packet["bad"]),
    ]
    names = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _damaged(path: str, count: int):
    """Rows of records that could not be read: the file, and bad."""
    import pyarrow as pa

    long, small, raw = pa.int64(), pa.int32(), pa.binary()
    kinds = [long, small, long, long, raw, raw, small, small, small, long]
    fields = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]
    columns = [
        pa.array([path] * count, pa.string()),
        *(pa.nulls(count, kind) for kind in kinds),
        pa.array([True] * count),
    ]
    return pa.RecordBatch.from_arrays(columns, names=fields)


def to_arrow_schema(ddl: str):
    """Arrow schema of a DDL string, for the driver to hand to its tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema as convert

    return convert(T.StructType.fromDDL(ddl))


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return files.load(folder).select("path", "length")


def capture_ranges(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, stop, marks): record ranges that together cover every file once.

    A file of up to `split_bytes` is one range. In a larger file no split knows where its
    first record starts, so it walks from every place near its start that may be one, to
    where the walks end; walks that meet count as one. The ends are joined with the starts
    of the splits that they lie in, and the links that the known first record leads along
    are the ranges, about one per split, whatever is damaged. One task per file follows
    them; it sees a few numbers per split.
    """
    files = _listing(spark, folder)
    whole = files.where(F.col("length") <= split_bytes).select(
        "path",
        F.lit(0).cast("bigint").alias("start"),
        F.col("length").alias("stop"),
        F.array().cast("array<binary>").alias("marks"),
    )
    large = files.where(F.col("length") > split_bytes)
    splits = large.select(
        "path",
        "length",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes))).alias(
            "first"
        ),
    ).select(
        "path",
        "first",
        F.least(F.col("first") + split_bytes, "length").alias("last"),
        F.lit(split_bytes).cast("bigint").alias("split"),
    )
    located = splits.repartition(_tasks(files, split_bytes), "path", "first").mapInArrow(
        _locate(to_arrow_schema(LINKS)), LINKS
    )
    # The walks are long, their table is small, and it is read twice.
    table = shared_dir(spark, "capture-links")
    located.write.parquet(table)
    located = spark.read.parquet(table)
    ahead = located.select(
        "path",
        F.explode("starts").alias("stop"),
        F.col("first").alias("next_first"),
        F.col("stop").alias("next_stop"),
    )
    linked = (
        located.join(ahead, ["path", "stop"], "left")
        .repartition("path")
        .sortWithinPartitions("path", "first", "stop")
        .select("path", "first", "stop", "starts", "marks", "next_first", "next_stop")
    )
    return whole.unionByName(linked.mapInArrow(_follow(to_arrow_schema(RANGES)), RANGES))


def _tasks(files: DataFrame, split_bytes: int) -> int:
    """About one task per range: one number from the file listing."""
    count = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0]
    return min(max(int(count or 0), 1), MOST_TASKS)


def _address_text(side: str):
    octets = ", ".join(f"shiftright({side}_v4, {shift}) & 255" for shift in (24, 16, 8, 0))
    v6 = canonical_ip_sql(f"regexp_replace(hex({side}_v6), '(.{{4}})(?!$)', '$1:')")
    return F.expr(
        f"CASE ip_version WHEN 4 THEN concat_ws('.', {octets}) WHEN 6 THEN {v6} END"
    ).alias(f"{side}_ip")


def capture_records(
    spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Every record of the capture files, with `bad` for what is not an IP packet."""
    tasks = _tasks(_listing(spark, folder), split_bytes)
    ranges = capture_ranges(spark, folder, split_bytes).repartition(tasks)
    records = ranges.mapInArrow(_decode, RECORD_SCHEMA)
    micros = F.call_function("div", F.col("ts_nanos"), F.lit(1000))
    return records.select(
        "file",
        "ts_nanos",
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"),
        "ip_version",
        _address_text("src"),
        _address_text("dst"),
        "src_port",
        "dst_port",
        "protocol",
        "length",
        "bad",
    )


def pcap_scan(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of all capture files of a folder; unparsable records are skipped."""
    return capture_records(spark, folder, split_bytes).where(~F.col("bad")).drop("bad")
