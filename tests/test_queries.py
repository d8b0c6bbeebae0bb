"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sql, name):
    got = registry.queries()[name](spark, SF_DIR)
    con = sql.cursor()
    con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(got.columns)
    want = [tuple(map(plain, r)) for r in con.fetchall()]
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert registry.entry(spark).columns == ["id", "coords", "is_core", "cluster_id"]
    rows = registry.entry(spark).collect()
    assert len(rows) == 150 and max(r.cluster_id for r in rows) == 8 and sum(r.cluster_id == -1 for r in rows) == 23


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
