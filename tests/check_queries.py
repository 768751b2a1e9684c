"""Compare registered queries with their SQL: python tests/check_queries.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

from tidewatch.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def checker(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind == "f":
            df[c] = df[c].astype(float) + 0.0
        elif kind in "iu":
            df[c] = df[c].astype("float64" if df[c].isna().any() else "int64")
        else:
            df[c] = df[c].where(df[c].notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """'' if equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got, want = plain(got), plain(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype.kind != b.dtype.kind:
            return f"{c}: type {a.dtype} vs {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not bool(np.all(same)):
            at = int(np.argmin(same.to_numpy()))
            return f"{c}: {int((~same).sum())} differ, first {a[at]!r} vs {b[at]!r}"
    return ""


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), checker(sf_dir)
    bad = 0
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            spent = time.time() - start
            sql = entry.oracle_sql().get(name)
            note = "no SQL" if sql is None else compare(got, con.execute(sql).df()) or "ok"
            rows = len(got)
        except Exception as error:  # report and go on with the next query
            spent, rows, note = time.time() - start, -1, f"ERROR {str(error)[:600]}"
        bad += note not in ("ok", "no SQL")
        print(f"{name:28s} {spent:6.2f}s {rows:8d} {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
