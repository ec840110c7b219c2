"""Run queries against their SQL in DuckDB: ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from workload.inputs import TABLES
from workload.registry import entries


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value) if value != value.to_integral_value() else int(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, path: str, name: str) -> dict:
    run, sql = entries()[name]
    start = time.time()
    frame = run(spark, path)
    rows = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    out = {"name": name, "rows": len(rows), "sec": round(took, 2)}
    if sql is None:
        return {**out, "ok": True, "oracle": None}
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = canonical(names, cursor.fetchall())
    out["sql_sec"] = round(time.time() - start, 2)
    actual = canonical(frame.columns, rows)
    out["ok"] = sorted(names) == sorted(frame.columns) and actual == expected
    if not out["ok"]:
        out["columns"] = (sorted(names), sorted(frame.columns))
        out["expected_rows"] = len(expected)
        out["difference"] = [p for p in zip(actual, expected) if p[0] != p[1]][:2]
    return out


def main() -> None:
    from logloom.session import local_session

    path = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entries())
    spark, con = local_session(cores=8), connect(path)
    bad = 0
    for name in wanted:
        try:
            result = compare(spark, con, path, name)
        except Exception as e:  # report and go on with the next query
            result = {"name": name, "ok": False, "error": f"{type(e).__name__}: {e}"[:1500]}
        bad += not result["ok"]
        if result["ok"]:
            note = "" if result.get("oracle", 1) else "  (no SQL)"
            empty = "  EMPTY" if not result["rows"] else ""
            print(f"ok   {name:32} {result['rows']:>8} rows {result['sec']:>7}s  sql {result.get('sql_sec')}{note}{empty}", flush=True)
        else:
            print("FAIL", result, flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} ok")


if __name__ == "__main__":
    main()
