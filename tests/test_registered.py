"""Every registered query equals its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connection, spark_rows, sql_rows

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def con(sf_dir):
    with connection(sf_dir) as opened:
        yield opened


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    result = spark_rows(driver.queries()[name](spark, sf_dir))
    expected = sql_rows(con, driver.oracle_sql()[name])
    assert result[0] == expected[0]
    assert result[1] == expected[1]


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
