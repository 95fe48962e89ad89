"""Distinct elements per flow, estimated with mergeable sketches.

Two storable forms: Spark's HyperLogLog sketches (one binary per flow), and a
table of ranks (flow, register, rank) made of plain integers. Both are combined
inside each task before the shuffle, so a flow with very many packets or elements
arrives as one sketch, or as m registers, per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.hashing import register, register_rank
from flowloom.functions.keys import flow_key, flow_label
from flowloom.model import SPREAD, key_columns

# 2^7 = 128 registers per flow.
LG_K = 7


def spread_sketches(
    packets: DataFrame,
    flow_fields: Iterable[str],
    element_fields: Iterable[str],
    lg_k: int = LG_K,
) -> DataFrame:
    """One HyperLogLog sketch per flow."""
    flow_fields = list(flow_fields)
    return (
        packets.groupBy(*key_columns(flow_fields))
        .agg(F.hll_sketch_agg(flow_key(element_fields), lg_k).alias("sketch"))
        .select(flow_label(flow_fields).alias("flow"), "sketch")
    )


def merge_spread_sketches(parts: DataFrame) -> DataFrame:
    """Union of the sketches of each flow."""
    return parts.groupBy("flow").agg(F.hll_union_agg("sketch").alias("sketch"))


def spread_estimates(sketches: DataFrame) -> DataFrame:
    """Estimated number of distinct elements per flow."""
    return sketches.select("flow", F.hll_sketch_estimate("sketch").alias("spread"))


def approx_spread(
    packets: DataFrame,
    flow_fields: Iterable[str],
    element_fields: Iterable[str],
    lg_k: int = LG_K,
) -> DataFrame:
    """Estimated number of distinct elements per flow, straight from packets."""
    return spread_estimates(spread_sketches(packets, flow_fields, element_fields, lg_k))


def spread_register_table(
    packets: DataFrame,
    flow_fields: Iterable[str],
    element_fields: Iterable[str],
    m: int = 1 << LG_K,
    size: int = 5,
    method: str = "xxhash64",
) -> DataFrame:
    """Largest rank per flow and register: at most m rows per flow."""
    element = flow_key(element_fields)
    return (
        packets.select(
            flow_label(flow_fields).alias("flow"),
            register(element, m, method).alias("register"),
            register_rank(element, size, method).alias("rank"),
        )
        .groupBy("flow", "register")
        .agg(F.max("rank").alias("rank"))
    )


def merge_spread_registers(parts: DataFrame) -> DataFrame:
    """Register tables of several days or sites as one."""
    return parts.groupBy("flow", "register").agg(F.max("rank").alias("rank"))


def register_estimates(registers: DataFrame, m: int = 1 << LG_K) -> DataFrame:
    """Spread per flow from its registers (HyperLogLog with linear counting)."""
    # The bias constants of the HyperLogLog estimator.
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    empty = F.lit(m) - F.count(F.lit(1))
    harmonic = F.sum(F.pow(F.lit(2.0), -F.col("rank"))) + empty
    sums = registers.groupBy("flow").agg(empty.alias("empty"), harmonic.alias("harmonic"))
    raw = F.lit(alpha * m * m) / F.col("harmonic")
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / F.col("empty"))
    small = (raw <= 2.5 * m) & (F.col("empty") > 0)
    estimate = F.when(small, linear).otherwise(raw)
    return sums.select("flow", F.round(estimate).cast("bigint").alias("spread"))


def super_spreaders(estimates: DataFrame, threshold: int) -> DataFrame:
    """(flow, value, type) of flows whose spread reaches the threshold, descending."""
    return (
        estimates.where(F.col("spread") >= threshold)
        .select("flow", F.col("spread").alias("value"), F.lit(SPREAD).alias("type"))
        .orderBy(F.desc("value"), F.asc("flow"))
    )


def spread_query(estimates: DataFrame, flows: DataFrame) -> DataFrame:
    """Estimated spread of each given flow, at least 1 even for unknown flows."""
    return flows.join(estimates, "flow", "left").select(
        *flows.columns, F.greatest(F.lit(1), F.coalesce("spread", F.lit(0))).alias("spread")
    )
