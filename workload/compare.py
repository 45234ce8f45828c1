"""Runs queries next to their SQL and compares the results, whatever the row order.

    python -m workload.compare [SF_DIR] [QUERY ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    result = con.sql(sql)
    return normalized(result.columns, result.fetchall())


def spark_rows(df):
    return normalized(df.columns, [tuple(r) for r in df.collect()])


def main() -> int:
    from answerlens.session import local_session
    from workload.catalog import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            got = spark_rows(QUERIES[name](spark, sf_dir))
        except Exception as error:  # go on with the other queries
            failed += 1
            print(f"{name:36s} FAILED {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - start
        if name not in ORACLES:
            print(f"{name:36s} rows only {len(got[1])} rows {spent:.2f}s", flush=True)
            continue
        start = time.time()
        try:
            want = oracle_rows(sf_dir, ORACLES[name])
        except duckdb.Error as error:
            failed += 1
            print(f"{name:36s} SQL FAILED {str(error)[:600]}", flush=True)
            continue
        same = got == want
        failed += not same
        print(f"{name:36s} {'ok' if same else 'DIFFERS'} {len(got[1])} rows {spent:.2f}s / {time.time() - start:.2f}s", flush=True)
        if not same:
            print("  columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
            mine, theirs = set(map(repr, got[1])), set(map(repr, want[1]))
            print("  only spark", [x[:300] for x in sorted(mine - theirs)[:4]])
            print("  only sql  ", [x[:300] for x in sorted(theirs - mine)[:4]])
    return failed


if __name__ == "__main__":
    sys.exit(main())
