"""Compare registered queries with their SQL twins in DuckDB: column names, types and row values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

#: Without a SQL twin; compared in tests/test_scale.py instead.
TESTED_ELSEWHERE = {"X17_vector_clusters"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"dec:{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, plan, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = plan(spark, sf_dir)
    rows = df.collect()
    spent = time.time() - start
    if sql is None:
        return name in TESTED_ELSEWHERE, f"rows={len(rows)} (no oracle) {spent:.2f}s"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    duck = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = normal(df.columns, rows), normal(names, expected)
    if got != want:
        extra = [g for g in got if g not in set(want)][:3]
        lack = [w for w in want if w not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}; spark only {str(extra)[:700]}; sql only {str(lack)[:700]}"
    return True, f"rows={len(rows)} {spent:.2f}s (sql {duck:.2f}s)"


def main(argv: list[str]) -> int:
    """``python -m tests.oracle sf_dir [name prefix ...]``"""
    from orfloom import local_session, plans

    plans.load()
    sf_dir, prefixes = argv[0], argv[1:]
    spark, con, bad = local_session(), connect(argv[0]), 0
    for name, plan in plans.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, plan, plans.ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
