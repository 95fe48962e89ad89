"""Flow keys, labels and padding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.model import KEY_TYPES, TCP, UDP, key_columns


def flow_key(fields: Iterable[str]) -> Column:
    """Key text, fields joined by '-'."""
    return F.concat_ws("-", *key_columns(fields))


def flow_label(fields: Iterable[str]) -> Column:
    """Display text, fields joined by a space."""
    return F.concat_ws(" ", *key_columns(fields))


def project_key(packets: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Only the chosen key fields, in the given order."""
    return packets.select(*key_columns(fields))


def pad_missing_keys(flows: DataFrame, fields: Iterable[str]) -> DataFrame:
    """All five key columns in fixed order first; those outside `fields` are NULL."""
    used = set(key_columns(fields))
    keys = [
        F.col(name) if name in used else F.lit(None).cast(kind).alias(name)
        for name, kind in KEY_TYPES.items()
    ]
    rest = [name for name in flows.columns if name not in KEY_TYPES]
    return flows.select(*keys, *rest)


def l4_port(port: str) -> Column:
    """The port of TCP and UDP packets, 0 for any other protocol."""
    return F.when(F.col("protocol").isin(TCP, UDP), F.col(port)).otherwise(F.lit(0))


def l4_ports(packets: DataFrame) -> DataFrame:
    """Packets with both ports zeroed where the protocol has none."""
    return packets.withColumns({name: l4_port(name) for name in ("src_port", "dst_port")})
