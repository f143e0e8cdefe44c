"""Run registered queries beside their SQL twins in DuckDB and compare all values.

Usage: python tests/compare.py FOLDER [NAME ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]")
        elif frame[c].dtype == object or str(frame[c].dtype) == "string" or str(frame[c].dtype) == "str":
            frame[c] = frame[c].astype(str)
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same rows in any order, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_float_dtype(x) != pd.api.types.is_float_dtype(y):
            return f"{c}: types {x.dtype} != {y.dtype}"
        if pd.api.types.is_float_dtype(x):
            x, y = x.to_numpy(float), y.to_numpy(float)
            equal = (x == y) | (np.isnan(x) & np.isnan(y))
        else:
            equal = ((x == y) | (x.isna() & y.isna())).to_numpy()
        if not equal.all():
            i = int(np.argmin(equal))
            return f"{c}: {int((~equal).sum())} of {len(a)} differ, e.g. {a[c][i]!r} != {b[c][i]!r}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from orderlens.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = duck(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            problem = difference(got, con.execute(sql[name]).df()) if name in sql else "rows only"
        except Exception as error:  # report and go on
            got, took, problem = [], time.time() - start, f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem not in (None, "rows only")
        print(f"{name:36} {len(got):7} rows {took:6.2f} s  {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
