"""Compare registered queries with their SQL on DuckDB, value by value."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridwatt.queries import oracle_sql, queries  # noqa: E402


#: Queries that SQL cannot ask, and the test of tests/test_operators.py that holds their operator against brute force or a planted answer.
NO_SQL = {
    "j3_cluster_members": "test_planted_clusters_are_found", "j4_silhouette_for_k": "test_planted_clusters_are_found", "j14_scenario_run": "test_planted_clusters_are_found",
    "k14_fit_load_curve": "test_fitted_curve_recovers_the_planted_one", "k15_fit_subset": "test_fitted_curve_recovers_the_planted_one",
    "m5_fit_state": "test_state_fit_finds_planted_answers",
    "n8_composite_p": "test_correlation_needs_years_and_variance", "n9_loo_regression": "test_regression_leaves_each_year_out",
    "n12_model_screen": "test_regression_leaves_each_year_out",
}


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def _kind(v):
    if isinstance(v, bool) or v is None:
        return None if v is None else "bool"
    for name, t in (("int", int), ("float", float), ("ts", dt.datetime), ("date", dt.date), ("str", str)):
        if isinstance(v, t):
            return name
    return type(v).__name__


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    df = queries()[name](spark, folder)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return name in NO_SQL, f"{len(rows)} rows, no SQL; tested by {NO_SQL.get(name, 'nothing')}"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    other = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    for j, c in enumerate(cols):
        a = {_kind(r[j]) for r in rows} - {None}
        b = {_kind(r[j]) for r in other} - {None}
        if a != b and rows and other:
            return False, f"type of {c}: {a} vs {b}; {len(rows)} vs {len(other)} rows"
    a = sorted(tuple(map(_norm, r)) for r in rows)
    b = sorted(tuple(map(_norm, r)) for r in other)
    if a == b:
        return True, f"{len(rows)} rows"
    sa, sb = set(a), set(b)
    extra, lack, n = sorted(sa - sb)[:2], sorted(sb - sa)[:2], len(sa - sb)
    return False, f"{len(a)} vs {len(b)} rows, {n} differ; {cols}\n   spark {extra}\n   duck  {lack}"


if __name__ == "__main__":
    from gridwatt.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for q in queries():
        if only and not any(q == o or (o.endswith("*") and q.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            ok, text = compare(spark, con, q, sf)
        except Exception as e:  # a broken query must not hide the others
            ok, text = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {q:34s} {time.time() - t:5.1f}s {text}", flush=True)
    print("failures:", bad)
