"""Local stand-in for the driver's correctness gate.

Runs every registered Spark query and its DuckDB oracle on the same parquet
directory and compares row count, column names and an order-insensitive hash
of the values.  Usage::

    python tools/check_oracle.py [sf_dir] [key ...]

``CHECK_TZ`` sets another session time zone, ``CHECK_PARTITIONS`` another
shuffle width with AQE off (order-dependence check).
"""

from __future__ import annotations

import hashlib
import os
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from shiftcast.registry import oracle_sql, queries  # noqa: E402
from shiftcast.session import get_spark  # noqa: E402
from shiftcast.sources.tables import TABLES  # noqa: E402


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows_hash(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in args if not a.startswith("/")]
    spark = get_spark("local[8]")
    if os.environ.get("CHECK_TZ"):  # run under another session zone, as a driver might
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_TZ"])
    if os.environ.get("CHECK_PARTITIONS"):  # other shuffle widths / AQE off expose order dependence
        spark.conf.set("spark.sql.shuffle.partitions", os.environ["CHECK_PARTITIONS"])
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(srows)} rows ({dt:.1f}s) [no oracle]")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        hs, ls = _rows_hash(scols, srows)
        hd, ld = _rows_hash(dcols, drows)
        if len(srows) != len(drows) or hs != hd:
            diff_s = [x for x in ls if x not in set(ld)][:3]
            diff_d = [x for x in ld if x not in set(ls)][:3]
            print(f"FAIL {name}: rows spark={len(srows)} duck={len(drows)}\n   spark-only {diff_s}\n   duck-only  {diff_d}")
            bad += 1
        else:
            print(f"ok   {name}: {len(srows)} rows ({dt:.1f}s)")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
