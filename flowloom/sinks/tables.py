"""Result tables as Parquet folders, text files and JSON summaries.

Tables are kept by month, then by writer and batch. An append without a writer is one of
its own and always adds rows. A writer that names itself and numbers its batches (a
stream) overwrites a batch that it repeats, and nothing else: a retry after a lost executor
or a restarted stream leaves the table as if written once, beside any other writer.
Rows are rebalanced by month, so a batch adds few files and a large one many tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.times import month_of, packet_line, snapshot_label
from flowloom.model import (
    COUNT,
    FLOW_METRICS_SCHEMA,
    HEAVY_HITTERS_SCHEMA,
    PACKET_SCHEMA,
    SIZE,
    SPREAD_SKETCHES_SCHEMA,
)
from flowloom.sources.packets import stored


def _append(
    rows: DataFrame, path: str, writer: str | None, batch_id: int, order: list[str]
) -> None:
    """Rows of one batch, by month; tasks and times are clustered inside files so
    that Parquet statistics can skip row groups."""
    (
        rows.withColumns(
            {
                "month": month_of(F.col("snapshot_ts")),
                "writer": F.lit(writer or uuid.uuid4().hex),
                "batch_id": F.lit(batch_id),
            }
        )
        .hint("rebalance", "month")
        .sortWithinPartitions("month", *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month", "writer", "batch_id")
        .parquet(path)
    )


def write_flow_metrics(
    flows: DataFrame, path: str, writer: str | None = None, batch_id: int = 0
) -> None:
    """Append snapshot rows. An empty snapshot adds no file."""
    rows = flows.select(*FLOW_METRICS_SCHEMA.names)
    _append(rows, path, writer, batch_id, ["task_name", "snapshot_ts"])


def write_heavy_hitters(
    hitters: DataFrame, path: str, writer: str | None = None, batch_id: int = 0
) -> None:
    """Append hitter rows."""
    rows = hitters.select(*HEAVY_HITTERS_SCHEMA.names)
    _append(rows, path, writer, batch_id, ["task_name", "type", "snapshot_ts"])


def write_spread_sketches(
    sketches: DataFrame, path: str, writer: str | None = None, batch_id: int = 0
) -> None:
    """Append sketches of flows and intervals."""
    rows = sketches.select(*SPREAD_SKETCHES_SCHEMA.names)
    _append(rows, path, writer, batch_id, ["task_name", "snapshot_ts"])


def compact_table(table: DataFrame, path: str) -> None:
    """Write the rows of a stored table anew, as one batch with few files per month."""
    kept = [name for name in table.columns if name not in ("month", "writer", "batch_id")]
    _append(table.select(*kept), path, "compacted", 0, ["task_name", "snapshot_ts"])


def spread_sketches_scan(spark: SparkSession, path: str) -> DataFrame:
    """The stored sketches of a streamed spread task."""
    return spark.read.schema(stored(SPREAD_SKETCHES_SCHEMA)).parquet(path)


def heavy_hitters_scan(spark: SparkSession, path: str) -> DataFrame:
    """The stored heavy_hitters table."""
    return spark.read.schema(stored(HEAVY_HITTERS_SCHEMA)).parquet(path)


# File names per hitter type.
TEXT_KINDS = {COUNT: "count_hh", SIZE: "size_hh"}
SPREAD_KIND = "spread_ss"


def write_hitter_text(hitters: DataFrame, path: str) -> None:
    """Lines `flow value`, in folders per snapshot label, task and kind, descending.

    The order runs through the part files of a folder: a range-partitioned sort.
    """
    kind = F.lit(SPREAD_KIND)
    for code, name in TEXT_KINDS.items():
        kind = F.when(F.col("type") == code, name).otherwise(kind)
    (
        hitters.select(
            snapshot_label(F.col("snapshot_ts")).alias("label"),
            F.col("task_name").alias("task"),
            kind.alias("kind"),
            "flow",
            "value",
        )
        .orderBy("label", "task", "kind", F.desc("value"), F.asc("flow"))
        .select("label", "task", "kind", F.concat_ws(" ", "flow", "value").alias("line"))
        .write.mode("overwrite")
        .partitionBy("label", "task", "kind")
        .text(path)
    )


def hitter_text_scan(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the hitter text files with their label, task and kind."""
    fields = ("value", "label", "task", "kind")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    return spark.read.schema(schema).text(path).withColumnRenamed("value", "line")


def write_snapshot_dir(flows: DataFrame, path: str) -> None:
    """Flows per snapshot and task, and a JSON summary beside each.

    Rows are rebalanced by folder, so that a folder gets few files and one with very
    many rows is still written by many tasks. The summaries are computed from the
    written flows, so the job that makes the flows runs once.
    """
    spark = flows.sparkSession
    label = snapshot_label(F.col("snapshot_ts"))
    flow_dir = f"{path.rstrip('/')}/flows"
    (
        flows.select(*FLOW_METRICS_SCHEMA.names)
        .withColumns({"label": label, "task": F.col("task_name")})
        .hint("rebalance", "label", "task")
        .write.mode("overwrite")
        .partitionBy("label", "task")
        .parquet(flow_dir)
    )
    written = snapshot_dir_scan(spark, path)
    totals = written.groupBy("label", "task_name").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("byte_count").alias("total_bytes"),
        F.sum("packet_count").alias("total_packets"),
    )
    (
        totals.withColumn("task", F.col("task_name"))
        .write.mode("overwrite")
        .partitionBy("label", "task")
        .json(f"{path.rstrip('/')}/summary")
    )


def snapshot_dir_scan(spark: SparkSession, path: str) -> DataFrame:
    """Flows of a snapshot folder."""
    folders = [T.StructField(name, T.StringType()) for name in ("label", "task")]
    schema = T.StructType([*FLOW_METRICS_SCHEMA.fields, *folders])
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/flows")


def summary_scan(spark: SparkSession, path: str) -> DataFrame:
    """JSON summaries of a snapshot folder."""
    counts = ("total_flows", "total_bytes", "total_packets")
    schema = T.StructType(
        [
            T.StructField("task_name", T.StringType()),
            *[T.StructField(name, T.LongType()) for name in counts],
            T.StructField("label", T.StringType()),
            T.StructField("task", T.StringType()),
        ]
    )
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/summary")


def write_packet_log(packets: DataFrame, path: str, encoding: str = "text") -> None:
    """Raw packet archive, as log lines or as Parquet."""
    if encoding == "text":
        packets.select(packet_line().alias("line")).write.mode("overwrite").text(path)
    elif encoding == "parquet":
        packets.select(*PACKET_SCHEMA.names).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown packet log encoding {encoding}")


def write_alerts(
    lines: DataFrame, path: str, writer: str | None = None, batch_id: int = 0
) -> None:
    """Append alert rows or digest lines; delivery is up to a reader of the table."""
    folder = f"{path.rstrip('/')}/writer={writer or uuid.uuid4().hex}/batch_id={batch_id}"
    lines.write.mode("overwrite").parquet(folder)
