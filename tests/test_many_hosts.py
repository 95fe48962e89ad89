"""Queries on tables with more hosts than two parts of an address can number."""

from __future__ import annotations

import duckdb
import pytest
from compare import spark_rows, sql_rows
from pyspark.sql import functions as F

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """12,000 users, each of one large packet, and parts numbered from 65,000."""
    folder = str(tmp_path_factory.mktemp("hosts"))
    kinds = F.array(*[F.lit(kind) for kind in ("click", "view", "purchase", "error", "signup")])
    spark.range(12_000).select(
        F.col("id").alias("event_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 200)").alias("ts"),
        (F.col("id") * 7).alias("user_id"),
        F.get(kinds, F.col("id") % 5).alias("event_type"),
        (F.col("id") % 50 + 7500).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") % 100, F.lit("}")).alias("props"),
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.withColumn("l_partkey", F.col("l_partkey") * 10 + 65_000).coalesce(1).write.parquet(
        f"{folder}/lineitem.parquet"
    )
    return folder


@pytest.fixture(scope="module")
def con(tables):
    with duckdb.connect() as opened:
        for table in ("events", "lineitem"):
            opened.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
        yield opened


@pytest.mark.parametrize(
    "name", ["pcap_scan", "pcapng_scan", "decode_payloads", "ingest_quality", "offline_job"]
)
def test_hosts_beyond_an_address_keep_their_names(spark, tables, con, name):
    result = spark_rows(driver.queries()[name](spark, tables))
    assert result == sql_rows(con, driver.oracle_sql()[name])


@pytest.mark.parametrize("name", ["vote_sketch", "merge_sketches", "run_sketch"])
def test_sources_that_share_all_their_buckets_are_counted(spark, tables, con, name):
    result = spark_rows(driver.queries()[name](spark, tables))
    assert result == sql_rows(con, driver.oracle_sql()[name])
