"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def names():
    from weftgraph import queries

    return sorted(n for m in queries.modules() for n in m.oracle_sql())


@pytest.fixture(scope="module")
def tools():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return entry.queries(), entry.oracle_sql(), db


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, tools, name):
    queries, sql, db = tools
    df = queries[name](spark, DIR)
    got = table([tuple(r) for r in df.collect()], df.columns)
    cur = db.execute(sql[name])
    assert got == table(cur.fetchall(), [d[0] for d in cur.description])


def test_entry(spark, tools):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
