"""Run queries and oracles side by side: ``python tests/compare.py sf0.01 [name ...]``."""

from __future__ import annotations

import importlib
import math
import os
import sys
import threading
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"
LIMIT = float(os.environ.get("COMPARE_LIMIT", "60"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf):
    """(ok, message) of one query against its oracle."""
    started = time.time()
    df = query(spark, f"{DATA}/{sf}")
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoop" in plan or "Cartesian" in plan:
        return False, "plan holds a nested-loop or Cartesian join"
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no oracle, {spent:.1f}s"
    started = time.time()
    con.execute(sql)
    want_columns, want = rows_of([d[0] for d in con.description], con.fetchall())
    oracle = time.time() - started
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} rows vs {len(want)}; only spark: {str(extra)[:700]}; only oracle: {str(missing)[:700]}"
    return len(got) > 0, f"{len(got)} rows match, {spent:.1f}s (oracle {oracle:.1f}s)"


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    from lectern import queries as q
    from lectern.session import build_session

    for module in q.MODULES:
        if os.path.exists(f"{ROOT}/lectern/queries/{module}.py"):
            importlib.import_module(f"lectern.queries.{module}")
    spark, con, bad = build_session(8), duck(sf), 0
    for name, query in q.QUERIES.items():
        if names and name not in names and query.__module__.rsplit(".", 1)[1] not in names:
            continue
        timer = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
        timer.start()
        try:
            ok, message = compare(spark, con, name, query, q.ORACLES.get(name), sf)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        timer.cancel()
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
