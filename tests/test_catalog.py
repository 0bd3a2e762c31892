"""Every registered query against its DuckDB oracle on sf0.001, plus the
entry-point smoke check."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _entries():
    from stepwise.catalog import load_all
    return load_all()


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except ImportError:
        pass
    if hasattr(v, "tolist") and not isinstance(v, (int, float, str)):
        v = v.tolist()
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    key = lambda r: tuple((x is None, f"{x:.6g}" if isinstance(x, float) else str(x)) for x in r)
    return cols, sorted(rows, key=key)


def _close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


@pytest.fixture(scope="module")
def con():
    from stepwise.plans.bindings import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    df = entry(spark)
    assert df.count() > 0
    assert set(oracle_sql()) <= set(queries())


SQL_NAMES = [n for n, e in _entries().items() if e.sql]


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_matches_oracle(spark, con, name):
    e = _entries()[name]
    got = e.fn(spark, SF).toPandas()
    want = con.execute(e.sql).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    for a, b in zip(r1, r2):
        assert all(_close(x, y) for x, y in zip(a, b)), (a, b)
