"""Run every registered query on Spark and its SQL oracle on DuckDB; compare row count,
column names and the order-insensitive multiset of values (doubles exact and to 1e-9).

usage: python scripts/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from labelq.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402
from labelq.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v, digits=None):
    if v is None:
        return (0, "")
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, (int, float)):
        v = float(v)
        if math.isnan(v):
            return (1, "nan")
        return (2, round(v, digits) if digits else v)
    return (5, str(v))


def rows_of(df_pd, digits=None):
    cols = sorted(df_pd.columns)
    out = []
    for rec in df_pd[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(None if (x is not None and not isinstance(x, str) and _isna(x)) else x, digits) for x in rec))
    return cols, sorted(out)


def _isna(x):
    try:
        import pandas as pd

        r = pd.isna(x)
        return bool(r) if not hasattr(r, "__len__") else False
    except Exception:
        return False


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = 0
    for n in names:
        t0 = time.time()
        try:
            s = QUERIES[n](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"SPARK-FAIL {n}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if n not in ORACLE_SQL:
            print(f"ROWS-ONLY  {n:28s} rows={len(s)} spark={ts:.2f}s")
            continue
        try:
            d = con.sql(ORACLE_SQL[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"SQL-FAIL   {n}: {str(e)[:400]}")
            continue
        sc, sr = rows_of(s)
        dc, dr = rows_of(d)
        if sc != dc:
            print(f"COLS       {n}: spark={sc} duck={dc}")
            continue
        if len(sr) != len(dr):
            print(f"COUNT      {n}: spark={len(sr)} duck={len(dr)}")
            continue
        if sr == dr:
            ok += 1
            print(f"MATCH      {n:28s} rows={len(sr)} spark={ts:.2f}s")
            continue
        _, sr9 = rows_of(s, 9)
        _, dr9 = rows_of(d, 9)
        if sr9 == dr9:
            ok += 1
            print(f"MATCH~1e-9 {n:28s} rows={len(sr)}")
            continue
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
        print(f"VALUES     {n}: {str(diff)[:700]}")
    print(f"{ok}/{len(names)} matched")


if __name__ == "__main__":
    main()
