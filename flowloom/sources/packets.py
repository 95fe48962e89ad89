"""Packet tables, packet streams, message payloads and stored snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.addresses import canonical_ip
from flowloom.functions.times import month_of, nanos_to_ts, ntz
from flowloom.model import FLOW_METRICS_SCHEMA, KEY_TYPES, PACKET_SCHEMA, WIRE_SCHEMA

# Folders of a stored table, from the outside.
FOLDERS = [
    T.StructField("month", T.StringType()),
    T.StructField("writer", T.StringType()),
    T.StructField("batch_id", T.LongType()),
]


def packets_scan(
    spark: SparkSession, path: str, file_format: str = "parquet", **options
) -> DataFrame:
    """Packet records under the fixed packet schema; nothing is inferred."""
    return spark.read.format(file_format).schema(PACKET_SCHEMA).options(**options).load(path)


def packets_stream(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    schema: T.StructType = PACKET_SCHEMA,
    **options,
) -> DataFrame:
    """Packets arriving as files in a folder, as event-time rows.

    Streams use zoned timestamps: watermarks do not accept zone-free ones.
    """
    stream = spark.readStream.format(file_format).schema(schema).options(**options).load(path)
    return zoned(stream) if "ts" in stream.columns else stream


def zoned(packets: DataFrame) -> DataFrame:
    """Packets with `ts` as the zoned timestamp that watermarks need."""
    return packets.withColumn("ts", F.col("ts").cast("timestamp"))


def subject_stream(spark: SparkSession, servers: str, subject: str, **options) -> DataFrame:
    """Packets published to a Kafka topic as JSON; undecodable messages are dropped and
    counted in the metrics `ingest_quality` of the query.

    Needs the Kafka connector on the session's class path.
    """
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", subject)
        .options(**options)
        .load()
    )
    decoded = observe_quality(
        decode_payloads(messages.select(F.col("value").cast("string").alias("payload")))
    )
    return decoded.where(~F.col("bad")).drop("payload", "bad")


def encode_payload() -> Column:
    """JSON message of a packet."""
    return F.to_json(
        F.struct(
            (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_unix_nano"),
            F.struct(*KEY_TYPES).alias("five_tuple"),
            F.col("length"),
        )
    )


def decode_payloads(messages: DataFrame, column: str = "payload") -> DataFrame:
    """Messages with packet columns and `bad`, true for what is not a whole packet.

    Text in another encoding, objects without a five-tuple, addresses that are none, ports
    above 65,535 and protocols above 255 are bad. Addresses get their canonical text.
    """
    wire = messages.withColumn("_wire", F.from_json(column, WIRE_SCHEMA, {"mode": "PERMISSIVE"}))
    nanos = F.col("_wire.timestamp_unix_nano")
    bad = F.coalesce(
        nanos.isNull() | F.col("_wire.length").isNull() | F.col("_wire.five_tuple").isNull(),
        F.lit(True),
    )
    parts = {}
    for name in KEY_TYPES:
        part = F.col(f"_wire.five_tuple.{name}")
        if name.endswith("_ip"):
            parts[name] = canonical_ip(f"_wire.five_tuple.{name}")
        else:
            parts[name] = F.when(part.between(0, 255 if name == "protocol" else 65535), part)
    decoded = wire.select(
        *messages.columns,
        nanos.alias("ts_nanos"),
        nanos_to_ts(nanos).alias("ts"),
        *[part.alias(name) for name, part in parts.items()],
        F.col("_wire.length").alias("length"),
        bad.alias("bad"),
    )
    whole = F.lit(True)
    for name in KEY_TYPES:
        whole = whole & F.col(name).isNotNull()
    return decoded.withColumn("bad", F.col("bad") | ~whole)


def ingest_quality(records: DataFrame) -> DataFrame:
    """Number of records read and of those that could not be parsed."""
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("bad")).alias("failed")
    )


def observe_quality(records: DataFrame, name: str = "ingest_quality") -> DataFrame:
    """The same counts as metrics of the running query, for streams and large scans."""
    return records.observe(
        name, F.count(F.lit(1)).alias("total"), F.count_if(F.col("bad")).alias("failed")
    )


def stored(schema: T.StructType) -> T.StructType:
    """Schema of a stored table: its columns and the folders it is kept in."""
    return T.StructType([*schema.fields, *FOLDERS])


def flow_metrics_scan(spark: SparkSession, path: str) -> DataFrame:
    """The stored flow_metrics table."""
    return spark.read.schema(stored(FLOW_METRICS_SCHEMA)).parquet(path)


def snapshot_scan(spark: SparkSession, path: str, snapshot_ts: datetime | str) -> DataFrame:
    """Rows of one stored snapshot; only its month is read."""
    at = ntz(snapshot_ts)
    return flow_metrics_scan(spark, path).where(
        (F.col("month") == month_of(at)) & (F.col("snapshot_ts") == at)
    )
