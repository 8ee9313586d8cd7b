"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python scripts/check_oracle.py [sf_dir] [name-substring ...]

Comparison: same row count, same column names, and equal values after
sorting rows on all columns (doubles compared after half-even rounding to
9 significant places, to show genuine differences only).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from keepwell.session import get_session  # noqa: E402
from keepwell.sources.tables import TABLE_NAMES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(sdf, ddf):
    scols = list(sdf.columns)
    dcols = list(ddf.columns)
    if sorted(scols) != sorted(dcols):
        return f"columns differ: spark={scols} duck={dcols}"
    if len(sdf) != len(ddf):
        return f"rows differ: spark={len(sdf)} duck={len(ddf)}"
    cols = sorted(scols)
    srows = sorted((tuple(norm(x) for x in r) for r in sdf[cols].astype(object).itertuples(index=False)), key=key)
    drows = sorted((tuple(norm(x) for x in r) for r in ddf[cols].astype(object).itertuples(index=False)), key=key)
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. cols={cols}\n spark={bad[0][0]}\n duck ={bad[0][1]}"
    return None


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    pats = [a for a in args if a != sf_dir]
    import importlib

    entry = importlib.import_module("__spark_entry__")
    qs = entry.queries()
    sqls = entry.oracle_sql()
    spark = get_session()
    con = duckdb.connect()
    for t in TABLE_NAMES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    ok = fail = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            fail += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            ddf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            fail += 1
            continue
        msg = compare(sdf, ddf)
        if msg:
            print(f"FAIL {name}: {msg}")
            fail += 1
        else:
            print(f"OK   {name}: {len(sdf)} rows {ts:.1f}s")
            ok += 1
    print(f"ok={ok} fail={fail}")


if __name__ == "__main__":
    main()
