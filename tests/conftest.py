from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from flowloom.model import PACKET_SCHEMA  # noqa: E402
from flowloom.session import prepare  # noqa: E402
from registered.catalog import by_value  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("flowloom-tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    by_value()
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def packets_of(spark):
    """Packets from (ts, src, dst, src_port, dst_port, protocol, length) rows."""

    def make(rows):
        numbered = [(i, *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(numbered, PACKET_SCHEMA)

    return make
