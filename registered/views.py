"""Packets as projections of the given tables, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = datetime(2024, 1, 1)
DAY = timedelta(days=1)
PERIOD = timedelta(days=10)

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)

EVENT_COLUMNS = [
    "event_id",
    "ts",
    "concat('10.0.', CAST(floor(user_id / 256) AS INT), '.', CAST(user_id % 256 AS INT)) AS src_ip",
    "concat('192.168.0.', CAST({k} AS INT)) AS dst_ip",
    "CAST(CASE WHEN event_type = 'signup' THEN 0 ELSE 40000 + user_id % 4 END AS INT) AS src_port",
    "CAST(CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8443 "
    "WHEN 'error' THEN 53 ELSE 0 END AS INT) AS dst_port",
    "CAST(CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 1 ELSE 6 END AS INT) AS protocol",
    "CAST(40 + floor(value) AS BIGINT) AS length",
]
LINEITEM_COLUMNS = [
    "l_orderkey * 10 + l_linenumber AS event_id",
    "l_shipdate AS ts",
    "concat('10.1.', CAST(floor(l_suppkey / 256) AS INT), '.', CAST(l_suppkey % 256 AS INT)) AS src_ip",
    "concat('172.16.', CAST(floor(l_partkey / 256) AS INT), '.', CAST(l_partkey % 256 AS INT)) AS dst_ip",
    "CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 40000 + l_linenumber END AS INT) AS src_port",
    "CAST(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 443 ELSE 80 END AS INT) AS dst_port",
    "CAST(CASE l_returnflag WHEN 'A' THEN 17 WHEN 'R' THEN 1 ELSE 6 END AS INT) AS protocol",
    "CAST(40 + floor(l_quantity) * 29 AS BIGINT) AS length",
]


def _spark(columns: list[str]) -> list[str]:
    return [column.replace("{k}", "get_json_object(props, '$.k')") for column in columns]


def _duckdb(columns: list[str]) -> str:
    return ",\n ".join(
        column.replace("{k}", "json_extract_string(props, '$.k')") for column in columns
    )


# Common table expressions that name the packets `p`.
EVENTS = f"p AS (SELECT {_duckdb(EVENT_COLUMNS)} FROM events)"
LINEITEM = f"p AS (SELECT {_duckdb(LINEITEM_COLUMNS)} FROM lineitem)"

KEYS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
FIVE = ", ".join(KEYS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_spark(EVENT_COLUMNS))


def lineitem_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_spark(LINEITEM_COLUMNS))


# The views number their hosts and print the number as two parts below these networks. From
# host 65,536 on the first part exceeds 255, and the text is no address. Captures and payloads
# carry the address at that distance from the start of the network instead.
EVENT_SOURCES = "10.0"
LINEITEM_NETWORKS = {"src_ip": "10.1", "dst_ip": "172.16"}


def address_number(address: str | Column) -> Column:
    """The number of four dotted parts, of which any may exceed 255."""
    column = F.col(address) if isinstance(address, str) else address
    parts = [F.element_at(F.split(column, "[.]"), place).cast("bigint") for place in range(1, 5)]
    return parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]


def on_wire(address: str | Column) -> Column:
    """The address of a host that a view names."""
    number = address_number(address)
    octets = [F.shiftright(number, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(number.isNotNull(), F.concat_ws(".", *octets))


def as_viewed(address: str | Column, network: str) -> Column:
    """The text by which a view names the host of an address."""
    host = address_number(address) - address_number(F.lit(f"{network}.0.0"))
    return F.concat(
        F.lit(f"{network}."),
        F.floor(host / 256).cast("string"),
        F.lit("."),
        F.pmod(host, F.lit(256)).cast("string"),
    )


def event_packets_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of packets."""
    from flowloom.sources.packets import zoned

    raw = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
    return zoned(raw.parquet(sf_dir).selectExpr(*_spark(EVENT_COLUMNS)))
