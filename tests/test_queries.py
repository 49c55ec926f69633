"""Every registered query runs; those with SQL give what DuckDB gives."""

import math
import os

import duckdb
import pytest

from lagloom.plans import registry

SF = "/root/testdata/sf0.01"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rows, names = df.collect(), sorted(df.columns)
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        want = sorted(tuple(norm(r[columns.index(c)]) for c in names) for r in found.fetchall())
        assert sorted(tuple(norm(r[c]) for c in names) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
