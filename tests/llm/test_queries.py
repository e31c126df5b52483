"""The registered training-data queries over whole tables, those with SQL against it."""

from pathlib import Path

import duckdb
import pytest

from scriptorium.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "p1_found": {"doc_id", "line_no"}, "p2_found": {"id", "field_name"}, "p3_found": {"id_a", "id_b"}, "p4_found": {"doc_id"}, "p5_found": {"table_name", "row_key"},
    "p6_ids": {"doc_id", "ids"}, "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0
    assert set(df.columns) == COLUMNS.get(name, set(df.columns))
    if name.endswith("_found"):
        assert df.distinct().count() == df.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for file in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    expected = con.execute(ORACLES[name])
    order = [c[0] for c in expected.description]
    got = QUERIES[name](spark, data).select(*order).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected.fetchall()))
