"""Registered queries against their SQL twins on the smallest tables.

One query of every id runs by default; DAYLOOM_ALL=1 runs all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from dayloom.plans import catalogue
from tools.check_oracle import TABLES, plain

SF = "/root/testdata/sf0.001"
#: The first query of every id, such as W07 of W07_prepared_panel.
FIRST = {name.split("_")[0]: name for name in reversed(list(catalogue.ORACLE))}
NAMES = list(catalogue.ORACLE) if os.environ.get("DAYLOOM_ALL") else sorted(FIRST.values())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
