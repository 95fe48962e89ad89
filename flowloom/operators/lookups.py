"""Point lookups and drill-down: equi-joins on flow keys.

No join carries a broadcast hint. Spark broadcasts a side when its measured size
is under the session threshold and otherwise shuffles, splitting skewed
partitions at run time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.model import KEY_TYPES, ExactTask, key_columns


def flow_lookup(flows: DataFrame, wanted: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Packets and bytes of each wanted key; 0 for keys that have no flow."""
    keys = key_columns(fields)
    return wanted.join(flows.select(*keys, "packet_count", "byte_count"), keys, "left").select(
        *wanted.columns,
        F.coalesce("packet_count", F.lit(0)).alias("packet_count"),
        F.coalesce("byte_count", F.lit(0)).alias("byte_count"),
    )


def drill_down(hitters: DataFrame, flow_metrics: DataFrame, task: ExactTask) -> DataFrame:
    """Exact rows of the flows that a sketch reported, from the rows of one exact task.

    Labels are taken apart into the key columns of the task, so that the join compares
    columns and the scan reads the task alone. `flow` is the label.
    """
    parts = F.split("flow", " ")
    keys = [
        F.get(parts, i).cast(KEY_TYPES[name]).alias(name) for i, name in enumerate(task.keys)
    ]
    found = hitters.select("flow").distinct().select("flow", *keys)
    return flow_metrics.where(F.col("task_name") == task.name).join(found, task.keys)
