"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: match / mismatch with row counts and a diff hint.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if hasattr(v, "item"):
        return canon(v.item())
    if v is pd.NaT:
        return "NULL"
    return str(v)


def table_rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(tuple(canon(None if (not isinstance(x, (list, dict)) and pd.isna(x)) else x) for x in rec))
    rows.sort()
    return cols, rows


def digest(rows) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update("\x1f".join(r).encode())
        h.update(b"\x1e")
    return h.hexdigest()[:16]


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as entry
    queries, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for key in keys or list(queries):
        t0 = time.time()
        try:
            sdf = queries[key](spark, sf_dir).toPandas()
        except Exception as exc:  # noqa: BLE001
            results[key] = ("spark-error", str(exc)[:300])
            print(f"{key:24s} SPARK ERROR {str(exc)[:300]}", flush=True)
            continue
        ts = time.time() - t0
        if key not in sqls:
            results[key] = ("rows-only", len(sdf))
            print(f"{key:24s} rows-only  rows={len(sdf)}  {ts:.1f}s", flush=True)
            continue
        try:
            ddf = con.execute(sqls[key]).df()
        except Exception as exc:  # noqa: BLE001
            results[key] = ("sql-error", str(exc)[:300])
            print(f"{key:24s} SQL ERROR {str(exc)[:300]}", flush=True)
            continue
        sc, sr = table_rows(sdf)
        dc, dr = table_rows(ddf)
        ok = sc == dc and len(sr) == len(dr) and digest(sr) == digest(dr)
        results[key] = ("match" if ok else "MISMATCH", len(sr), len(dr))
        line = f"{key:24s} {'match   ' if ok else 'MISMATCH'} spark={len(sr)} oracle={len(dr)} {ts:.1f}s"
        if not ok and verbose:
            if sc != dc:
                line += f"\n    cols spark={sc}\n    cols duck ={dc}"
            else:
                a, b = set(sr), set(dr)
                line += f"\n    only spark: {sorted(a - b)[:3]}\n    only duck : {sorted(b - a)[:3]}"
        print(line, flush=True)
    return results


if __name__ == "__main__":
    from crashgrid.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if v[0] not in ("match", "rows-only")]
    print(f"TOTAL {len(res)} bad={len(bad)} {bad}")
