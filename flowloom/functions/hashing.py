"""Seeded buckets and register ranks.

`xxhash64` is the fast default. `md5` gives values that any SQL engine can
recompute, for comparisons across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASHES = ("xxhash64", "md5")


def _md5_word(text: Column, position: int) -> Column:
    """32 bits of the md5 of `text`, starting at a hex digit position."""
    return F.conv(F.substring(F.md5(text), position, 8), 16, 10).cast("bigint")


def _known(method: str) -> None:
    if method not in HASHES:
        raise ValueError(f"unknown hash {method}, expected one of {HASHES}")


def seeded_bucket(row: Column, key: Column, width: int, method: str = "xxhash64") -> Column:
    """Bucket of `key` in sketch row `row`."""
    _known(method)
    if method == "md5":
        word = _md5_word(F.concat(row.cast("string"), F.lit(":"), key), 1)
        return (word % F.lit(width)).cast("int")
    return F.pmod(F.xxhash64(row, key), F.lit(width)).cast("int")


def seeded_buckets(key: Column, depth: int, width: int, method: str = "xxhash64") -> Column:
    """One (row, bucket) struct per sketch row, as an array."""
    return F.array(
        *[
            F.struct(
                F.lit(row).alias("row"),
                seeded_bucket(F.lit(row), key, width, method).alias("bucket"),
            )
            for row in range(depth)
        ]
    )


def register(element: Column, m: int, method: str = "xxhash64") -> Column:
    """Register number of an element, 0 to m - 1."""
    _known(method)
    word = _md5_word(element, 9) if method == "md5" else F.xxhash64(element).bitwiseAND(0xFFFFFFFF)
    return (word % F.lit(m)).cast("int")


def register_rank(element: Column, size: int, method: str = "xxhash64") -> Column:
    """Leading zeros + 1 of a 32-bit hash of the element, at most 2^size - 1."""
    _known(method)
    if method == "md5":
        word = _md5_word(element, 1)
    else:
        word = F.shiftrightunsigned(F.xxhash64(element), 32)
    # Fill every bit below the highest one; the bits left are the leading zeros.
    for step in (1, 2, 4, 8, 16):
        word = word.bitwiseOR(F.shiftright(word, step))
    return F.least(F.lit(33) - F.bit_count(word), F.lit((1 << size) - 1))
