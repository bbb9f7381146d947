"""Run registered queries against their oracle SQL: python tests/compare.py [name ...] [--sf 0.01]."""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle_frame(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns differ: {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} / {len(b)}"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"values differ in {len(only_a)} rows: {sorted(got.columns)}\n  spark {only_a[:3]}\n  sql   {only_b[:3]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from panelforge.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, sf_dir = entry.queries(), entry.oracle_sql(), f"/root/testdata/sf{args.sf}"
    failed = 0
    for name in args.names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            problem = difference(got, oracle_frame(sf_dir, oracles[name])) if name in oracles else None
            note = "ok" if name in oracles else "rows only"
            if len(got) == 0:
                note += " (EMPTY)"
        except Exception as exc:  # noqa: BLE001
            took, problem, got, note = time.time() - start, f"{type(exc).__name__}: {str(exc)[:1500]}", [], ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'PASS'} {name:32s} rows={len(got):6d} {took:6.1f}s {problem or note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
