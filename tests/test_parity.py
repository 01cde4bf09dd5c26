"""Every registered query against its SQL over the small tables; those without SQL must have rows and give the same ones again."""

import datetime
import glob
import math
import os

import pytest

import __spark_entry__ as entry
from millrace.plans import oracles, queries

duckdb = pytest.importorskip("duckdb")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def compare(spark, small, name, query, sql, may_be_empty=False):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, small)
    rows = df.collect()
    if sql is None:
        # nothing to compare with: there are rows of one shape, and a second run gives the same ones
        assert (rows or may_be_empty) and all(tuple(r.__fields__) == tuple(df.columns) for r in rows)
        shown = lambda found: sorted(tuple(norm(x) for x in r) for r in found)
        assert shown(rows) == shown(query(spark, small).collect())
        return
    r = con.execute(sql)
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    theirs = sorted(tuple(norm(row[columns.index(c)]) for c in order) for row in r.fetchall())
    assert sorted(tuple(norm(row[c]) for c in order) for row in rows) == theirs


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_core(spark, small, name):
    compare(spark, small, name, queries.queries()[name], oracles.oracle_sql().get(name))


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
