"""Run registered queries next to their SQL in DuckDB and compare rows.

Usage: python tests/oracle.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canon(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    return v


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(canon(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


def same(a, b, tol: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tol
    return a == b


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, tol: float = 0.0) -> str | None:
    """None when equal, otherwise the first difference found."""
    sc, sr = rows_of(spark_pdf)
    dc, dr = rows_of(duck_pdf)
    if sc != dc:
        return f"columns differ: spark {sc} sql {dc}"
    if len(sr) != len(dr):
        return f"row counts differ: spark {len(sr)} sql {len(dr)}"
    for a, b in zip(sr, dr):
        if not all(same(x, y, tol) for x, y in zip(a, b)):
            return f"rows differ ({sum(x != y for x, y in zip(sr, dr))}): cols {sc}\n  spark {a}\n  sql   {b}"
    kinds = {"i": "int", "u": "int", "f": "float", "O": "obj", "M": "time", "b": "bool"}
    for c in sc:
        a, b = spark_pdf[c].dtype.kind, duck_pdf[c].dtype.kind
        if {a, b} <= {"i", "u", "f"} and spark_pdf[c].isna().any():
            continue  # an integer with NULLs has no one type in pandas
        if kinds.get(a, a) != kinds.get(b, b) and len(spark_pdf):
            return f"type of {c}: spark {spark_pdf[c].dtype} sql {duck_pdf[c].dtype}"
    return None


def main() -> int:
    from tickloom import build_session
    from tickloom.plans.registry import all_queries, all_sql

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), all_sql(), 0
    for name, fn in all_queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - t
            verdict = compare(got, con.execute(sqls[name]).df()) if name in sqls else None
            note = f"rows={len(got)}" + ("" if name in sqls else " (no sql)")
            if len(got) == 0:
                note += " EMPTY"
        except Exception as exc:  # noqa: BLE001 - report and go on
            took, verdict, note = time.time() - t, f"{type(exc).__name__}: {str(exc)[:260]}", ""
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {took:.1f}s {note}" + (f"\n{verdict}" if verdict else ""),
              flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main() and 1)
