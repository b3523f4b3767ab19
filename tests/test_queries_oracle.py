"""Every registered query against its DuckDB oracle on sf0.001 (the driver's check runs
sf0.01 through scripts/oracle_check.py)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from labelq.plans.registry import QUERIES as OWN_QUERIES
from tests.conftest import SF001

TABLES = "events documents benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return (0, "")
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, (int, float)):
        v = float(v)
        return (1, "nan") if math.isnan(v) else (2, round(v, 9))
    return (5, str(v))


def _rows(pdf):
    cols = sorted(pdf.columns)
    import pandas as pd

    return cols, sorted(tuple(_norm(None if (not isinstance(x, str) and x is not None and pd.isna(x)) else x) for x in r)
                        for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


QUERIES = {k: v for k, v in entry_mod.queries().items() if k in OWN_QUERIES}
ORACLES = {k: v for k, v in entry_mod.oracle_sql().items() if k in OWN_QUERIES}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    s = QUERIES[name](spark, SF001).toPandas()
    d = duck.sql(ORACLES[name]).df()
    sc, sr = _rows(s)
    dc, dr = _rows(d)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "f1" in df.columns
