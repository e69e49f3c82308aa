"""Run registered queries against their DuckDB oracles (like the driver's check).

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: rows, schema (column names) and value match.
Values are compared order-insensitively after rounding floats.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.4f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from pricelens.session import get_session
    spark = get_session("local[8]", int(os.environ.get("SHUFFLE_PARTITIONS", "8")))
    if os.environ.get("SESSION_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["SESSION_TZ"])
    if os.environ.get("QUANTILE_METHOD"):
        spark.conf.set("pricelens.quantile.method", os.environ["QUANTILE_METHOD"])
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in os_:
            print(f"{name}: rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(os_[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: DUCKDB ERROR {str(e)[:400]}")
            bad += 1
            continue
        same_cols = sorted(scols) == sorted(dcols)
        hs, ls = digest(srows, scols)
        hd, ld = digest(drows, dcols)
        ok = same_cols and len(srows) == len(drows) and hs == hd
        bad += not ok
        print(f"{name}: {'OK' if ok else 'MISMATCH'} rows={len(srows)}/{len(drows)} "
              f"cols={'ok' if same_cols else (sorted(scols), sorted(dcols))} {ts:.1f}s")
        if not ok and same_cols:
            a, b = set(ls), set(ld)
            for x in list(a - b)[:3]:
                print("   spark :", x[:300])
            for x in list(b - a)[:3]:
                print("   duckdb:", x[:300])
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
