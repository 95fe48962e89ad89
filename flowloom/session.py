"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Settings the jobs are written for. Shuffle partition counts, memory and the
# cluster master belong to the deployment and are not set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming state larger than executor memory spills to local RocksDB files
    # and is restored from the checkpoint.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Counting the rows of the state would look up every key once more before it is written.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS and make this package's task code self-contained."""
    import flowloom

    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    # Arrow stages and data sources travel to executors by value, so a cluster
    # needs no installed copy of this package.
    if flowloom.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(flowloom)
    return spark


def parallelism(spark: SparkSession) -> int:
    """Tasks that keep the deployment busy: its cores, or its shuffle partitions."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, spark.sparkContext.defaultParallelism)


@cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="flowloom-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for tables and checkpoints that every executor can reach.

    Taken under `spark.checkpoint.dir`. Only a local master, whose driver and
    executors are one process, may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = _local_base()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
