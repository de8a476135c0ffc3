"""Every registered query of the library's own operators gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from ohmline.plans import fleet_queries, fleet_sql, log_queries, series_queries, source_queries

DIR = os.environ.get("OHMLINE_TEST_DIR", "/root/testdata/sf0.001")
QUERIES = series_queries.QUERIES | log_queries.QUERIES | fleet_queries.QUERIES | source_queries.QUERIES
SQL = series_queries.SQL | log_queries.SQL | fleet_sql.SQL | source_queries.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert mine == theirs


def test_all_have_a_query():
    assert set(SQL) <= set(QUERIES)
