"""Every registered metrics query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tempograin import queries as metrics

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(DATA):
        out.execute(f"create view {f.removesuffix('.parquet')} as from '{DATA}/{f}'")
    return out


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", metrics.oracle_sql())
def test_same_as_sql(spark, con, name):
    made = metrics.queries()[name](spark, DATA)
    wanted = con.execute(metrics.oracle_sql()[name])
    names = [x[0] for x in wanted.description]
    assert sorted(made.columns) == sorted(names)
    rows = sorted([plain(r[c]) for c in names] for r in made.collect())
    assert rows == sorted([plain(v) for v in r] for r in wanted.fetchall())
