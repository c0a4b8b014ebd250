"""Run registered queries against their SQL twins in DuckDB.

``python -m tests.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return "0.0" if value == 0 else repr(value)
    return repr(value)


def as_multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def check(spark, con, sf_dir, name, fn, sql):
    """(row count, problem or empty string)."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), ""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = as_multiset(df.columns, got), as_multiset(columns, want)
    if a != b:
        return len(got), f"rows {len(got)} vs {len(want)}; ours only {list((a - b).items())[:2]}; sql only {list((b - a).items())[:2]}"
    return len(got), ""


def main(args: list[str]) -> int:
    from scenelake.session import local_session
    from workload import ORACLES, QUERIES

    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            rows, problem = check(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # report and go on with the next query
            rows, problem = 0, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'BAD' if problem else 'ok ':4}{name:26}{rows:8} {time.time() - start:6.2f}s {kind} {problem}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
