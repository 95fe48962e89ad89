"""Blocks of pcapng files: sections, interfaces and packets.

A block tells its length at both ends, in the byte order of its section, so a place is a
block if both agree; the byte order is the one in which they do. Packets name an interface
of their section, whose block came before and says the kind of frames and the resolution of
the clock. Whoever reads from the middle of a file is given the blocks of the section and
its interfaces so far, the marks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Block types, the byte-order mark and the options that are read.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, ENHANCED_PACKET = 0x0A0D0D0A, 1, 2, 3, 6
KNOWN_TYPES = (SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, 4, 5, ENHANCED_PACKET)
MAGIC = b"\x0a\x0d\x0d\x0a"
BYTE_ORDER = 0x1A2B3C4D
RESOLUTION, TIME_OFFSET = 9, 14
# Longer blocks count as damaged; bytes read at a time are a multiple of it.
LONGEST_BLOCK = 1 << 20
PIECE = 8 * LONGEST_BLOCK
ORDERS = ("<", ">")


def block_at(data, place: int, order: str | None = None) -> tuple[int, str] | None:
    """(length, byte order) of the block at a place of `data`, if there is a whole one.

    A section says its own byte order; other blocks have `order`, or either if that is None.
    """
    if place + 12 > len(data):
        return None
    orders = [order] if order else ORDERS
    if data[place : place + 4] == MAGIC:
        orders = [x for x in ORDERS if data[place + 8 : place + 12] == struct.pack(f"{x}I", BYTE_ORDER)]
    for order in orders:
        (length,) = struct.unpack_from(f"{order}I", data, place + 4)
        if 12 <= length <= LONGEST_BLOCK and length % 4 == 0 and place + length <= len(data):
            if struct.unpack_from(f"{order}I", data, place + length - 4)[0] == length:
                return length, order
    return None


def blocks_in(data, order: str | None = None, known: bool = True) -> list[int]:
    """All places of `data` where a block stands, in a byte order or either.

    With `known` only those of known types, which are taken for blocks behind damage.
    """
    import numpy as np

    if len(data) < 12:
        return []
    found = []
    for each in ORDERS:
        words = np.empty(len(data) - 3, dtype=f"{each}u4")
        for k in range(4):
            words[k::4] = np.frombuffer(data, words.dtype, (len(data) - k) // 4, k)
        lengths = words[4:-4]
        at = np.flatnonzero((lengths >= 12) & (lengths <= LONGEST_BLOCK) & (lengths % 4 == 0))
        ends = at + words[at + 4].astype(np.int64)
        at, ends = at[ends <= len(data)], ends[ends <= len(data)]
        same = words[ends - 4] == words[at + 4]
        if order not in (None, each):
            same &= words[at] == SECTION
        elif known:
            same &= np.isin(words[at], KNOWN_TYPES)
        found += [place for place in at[same].tolist() if block_at(data, place, each)]
    return sorted(set(found))


def walk_blocks(file, begin: int, stop: int, split: int | None = None) -> Iterator[tuple]:
    """(bytes, their place, (place, length, order) of blocks, damaged ones, position after).

    Ends at the first block at or after `stop`; with `split`, no farther behind a multiple
    of it than a block reaches. Where no block stands, reading goes on at the next block of a
    known type in the byte order so far, or at the next section, and what is between is one
    damaged block.
    """
    held, held_at, position, order = b"", begin, begin, None
    done = False
    while position < file.size and not done:
        if position + LONGEST_BLOCK > held_at + len(held) and held_at + len(held) < file.size:
            held = held[position - held_at :]
            held_at = position
            held += file.read(held_at + len(held), PIECE)
        ended = held_at + len(held) >= file.size
        blocks, place, damaged = [], position - held_at, False
        while place < len(held) and (ended or place + LONGEST_BLOCK <= len(held)):
            found = block_at(held, place, order)
            damaged = found is None
            if damaged:
                break
            if held_at + place >= stop:
                done = split is None or (held_at + place) % split < LONGEST_BLOCK
                if done:
                    break
                stop = ((held_at + place) // split + 1) * split
            blocks.append((place, *found))
            place, order = place + found[0], found[1]
        position = held_at + place
        if damaged:
            position = _block_after(file, position + 1, order)
        yield held, held_at, blocks, int(damaged), position


def _block_after(file, position: int, order: str | None) -> int:
    """The first block of a known type from `position` on, or the end of the file."""
    while position < file.size:
        found = blocks_in(file.read(position, 4 * LONGEST_BLOCK), order)
        if found:
            return position + found[0]
        position += 3 * LONGEST_BLOCK
    return file.size


def block_links(file, first: int, last: int, split: int) -> list[tuple]:
    """(end, starts, marks): where walks from the blocks near `first` through `last` end.

    `marks` are the (place, block) of the sections and interfaces on the way.
    """
    if first:
        near = min(last, first + LONGEST_BLOCK)
        data = file.read(first, near - first + LONGEST_BLOCK)
        starts = [first + at for at in blocks_in(data, known=False) if first + at < near]
    else:
        starts = [0]
    ends: dict[int, int] = {}  # by every block that a walk passed
    out: dict[int, tuple[list, dict]] = {}
    for start in starts:
        if start not in ends:
            passed, marks, end = [start], {}, start
            for held, held_at, blocks, _, end in walk_blocks(file, start, last, split):
                known = next((ends[held_at + b[0]] for b in blocks if held_at + b[0] in ends), None)
                passed += [held_at + place for place, *_ in blocks if held_at + place < first + LONGEST_BLOCK]
                marks |= {
                    held_at + place: bytes(held[place : place + length])
                    for place, length, order in blocks
                    if struct.unpack_from(f"{order}I", held, place)[0] in (SECTION, INTERFACE)
                }
                if known is not None:
                    end = known
                    break
            ends |= dict.fromkeys(passed, end)
            out.setdefault(end, ([], {}))[1].update(marks)
        out[ends[start]][0].append(start)
    return [(end, starts, sorted(marks.items())) for end, (starts, marks) in out.items()]


class Interfaces:
    """The interfaces of a section, from its marks on."""

    def __init__(self, marks=()):
        self.known: list[tuple] = []
        for block in marks:
            self.add(block)

    def add(self, block: bytes) -> None:
        order = block_at(block, 0)[1]
        (kind,) = struct.unpack_from(f"{order}I", block)
        if kind == SECTION:
            self.known = []
        elif kind == INTERFACE and len(block) >= 20:
            link_type, _, snap = struct.unpack_from(f"{order}HHI", block, 8)
            options = dict(self._options(block[16:-4], order))
            resolution = options.get(RESOLUTION, b"\x06")[:1]
            offset = options.get(TIME_OFFSET, bytes(8))[:8].ljust(8, b"\0")
            self.known.append(
                (link_type, snap, resolution[0], struct.unpack(f"{order}q", offset)[0])
            )

    @staticmethod
    def _options(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
        at = 0
        while at + 4 <= len(data):
            code, size = struct.unpack_from(f"{order}HH", data, at)
            if code == 0:
                return
            yield code, data[at + 4 : at + 4 + size]
            at += 4 + (size + 3) // 4 * 4


def nanos_of(ticks, resolution: int, offset: int):
    """Unix nanoseconds of clock ticks, for a resolution as interfaces state it."""
    import numpy as np

    ticks = ticks.astype(np.uint64)
    power = resolution & 0x7F
    if resolution & 0x80:
        # 2**-power seconds; below 2**-33 a tick is less than a nanosecond.
        whole = ticks >> np.uint64(min(power, 63))
        part = ticks & np.uint64((1 << min(power, 63)) - 1)
        spare = max(0, power - 33)
        part = ((part >> np.uint64(spare)) * np.uint64(10**9)) >> np.uint64(power - spare)
        nanos = whole * np.uint64(10**9) + part
    elif power <= 9:
        nanos = ticks * np.uint64(10 ** (9 - power))
    else:
        nanos = ticks // np.uint64(10 ** min(power - 9, 19))
    return nanos.astype(np.int64) + offset * 10**9


def packets_of(held: bytes, blocks: list[tuple], interfaces: Interfaces) -> list[tuple]:
    """(interface, ticks or None, place of the frame, captured, length) of packet blocks.

    The interface is None where the section has no such one, and captured bytes that do not
    fit the block are cut. Sections and interfaces on the way are taken into `interfaces`.
    """
    out = []
    for place, length, order in blocks:
        (kind,) = struct.unpack_from(f"{order}I", held, place)
        if kind in (SECTION, INTERFACE):
            interfaces.add(held[place : place + length])
        elif kind in (ENHANCED_PACKET, OLD_PACKET) and length >= 32:
            number, high, low, kept, size = struct.unpack_from(f"{order}IIIII", held, place + 8)
            if kind == OLD_PACKET:
                (number,) = struct.unpack_from(f"{order}H", held, place + 8)
            known = interfaces.known[number] if number < len(interfaces.known) else None
            out.append((known, high << 32 | low, place + 28, min(kept, length - 32), size))
        elif kind == SIMPLE_PACKET and length >= 16:
            (size,) = struct.unpack_from(f"{order}I", held, place + 8)
            known = interfaces.known[0] if interfaces.known else None
            kept = min(size, length - 16, known[1] or size) if known else 0
            out.append((known, None, place + 12, kept, size))
    return out
