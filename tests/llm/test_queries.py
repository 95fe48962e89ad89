from __future__ import annotations

import duckdb
import pytest

from flowloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    expected = connection.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    found = QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_a_row_for_each_of_its_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    key = rows.columns[0]
    if key in ("doc_id", "page_id") and name != "op9_licence_scan":
        table = "documents" if key == "doc_id" else "pages"
        wanted = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()
        assert rows.select(key).distinct().count() == wanted
    assert rows.count() > 0
