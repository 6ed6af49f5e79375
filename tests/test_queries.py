"""Every query with SQL gives the same rows as DuckDB on the driver's smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lodestar import plans

SF = "/root/testdata/sf0.001"


def rows(table, cols):
    return sorted(map(repr, zip(*[table[c].to_pylist() for c in cols])))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, db, name):
    got = plans.QUERIES[name](spark, SF).toArrow()
    want = db.sql(plans.SQL[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert rows(got, cols) == rows(want, cols)


def test_every_query_has_sql_or_is_known_not_to():
    assert set(plans.SQL) <= set(plans.QUERIES)


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
