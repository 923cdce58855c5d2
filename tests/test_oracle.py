"""Every registered query of the library against its DuckDB statement on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tests.conftest import SF_DIR
from tidebar.plans import registry

NAMES = sorted(registry.oracle())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    rows = [tuple(round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if v is not None else None for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    want = duck.execute(registry.oracle()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-4 * max(1.0, abs(v)))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["symbol", "t", "bb_upper", "bb_middle", "bb_lower"]
