"""Every registered query of the engine against its SQL, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from scriptorium.plans.catalog import ORACLES, QUERIES


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(round(x, 6))
        return str(x)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, sql, name):
    got = QUERIES[name](spark, data)
    expected = sql.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(expected.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_module(spark, data):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
