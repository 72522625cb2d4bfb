"""Every registered query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.plans.oracle import ORACLE
from gleanery.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tidy(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else repr(x + 0.0)
    return repr(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(tidy(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert name == "cosine_pairs_lsh"
        return
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, found.fetchall())
    assert got == want
    # jobs of a whole language may have no gap; the small ones have some for each purpose
    assert got or (name.startswith("coverage_gaps") and "small_jobs" not in name) or name.startswith("rule_low")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
