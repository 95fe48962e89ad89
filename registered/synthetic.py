"""Random TCP over IPv4 packets that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.times import ntz
from flowloom.model import TCP

# Port and payload ranges, and the bytes of the three headers.
FIRST_PORT, PORTS = 1024, 64511
SMALLEST_PAYLOAD, PAYLOADS = 50, 1400
HEADER_BYTES = 14 + 20 + 20


def synthetic_packets(
    source: SparkSession | DataFrame, n: int | None = None, seed: int = 0
) -> DataFrame:
    """One packet per id: n ids from a session, or the rows of a table with `id`.

    Every value is a hash of (id, seed, purpose), so equal ids give equal packets
    on any cluster and after any retry.
    """
    ids = source.range(n) if isinstance(source, SparkSession) else source.select("id")

    def drawn(purpose: str, size: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(purpose)), F.lit(size))

    def address(side: str) -> Column:
        parts = [drawn(f"{side}{place}", 256).cast("string") for place in range(4)]
        return F.concat_ws(".", *parts)

    return ids.select(
        F.col("id").alias("event_id"),
        (ntz("2024-01-01 00:00:00") + F.make_dt_interval(secs=F.col("id") / F.lit(1000))).alias("ts"),
        address("src").alias("src_ip"),
        address("dst").alias("dst_ip"),
        (drawn("src_port", PORTS) + FIRST_PORT).cast("int").alias("src_port"),
        (drawn("dst_port", PORTS) + FIRST_PORT).cast("int").alias("dst_port"),
        F.lit(TCP).alias("protocol"),
        (drawn("payload", PAYLOADS) + SMALLEST_PAYLOAD + HEADER_BYTES).alias("length"),
    )
