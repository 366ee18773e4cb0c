"""Run every registered query on Spark and its DuckDB statement, and compare.

    python checks/compare.py [sf_dir] [key ...]

Prints one line per key: rows on each side and whether the sorted rows are equal.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from checks.oracle_sql import SQL  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from linewatch.session import get_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols]
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf.itertuples(index=False)), key=repr)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    spark = get_session()
    bad = 0
    for key in keys:
        t0 = time.time()
        try:
            sdf = QUERIES[key](spark, sf_dir)
            s_cols, s_rows = _rows(sdf.toPandas())
        except Exception as e:  # noqa: BLE001
            print(f"{key:30s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        if key not in SQL:
            print(f"{key:30s} spark={len(s_rows):7d} (no oracle) {t1 - t0:.2f}s")
            continue
        try:
            d_cols, d_rows = _rows(con.execute(SQL[key]).df())
        except Exception as e:  # noqa: BLE001
            print(f"{key:30s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ok = s_cols == d_cols and s_rows == d_rows
        bad += not ok
        print(f"{key:30s} spark={len(s_rows):7d} duck={len(d_rows):7d} {'OK ' if ok else 'DIFF'} {t1 - t0:.2f}s")
        if not ok:
            if s_cols != d_cols:
                print("   cols", s_cols, d_cols)
            sd, dd = set(s_rows), set(d_rows)
            print("   only spark:", sorted(sd - dd, key=repr)[:3])
            print("   only duck :", sorted(dd - sd, key=repr)[:3])
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
