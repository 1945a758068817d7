"""Compare registered queries with their oracle SQL: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value + 0.0, 6)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, con, sf_dir: str, build, sql: str) -> str:
    """'' when equal, else what differs."""
    frame = build(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns: {sorted(frame.columns)} != {sorted(names)}"
    ours, theirs = table(frame.columns, frame.collect()), table(names, result.fetchall())
    if ours == theirs:
        return ""
    extra, missing = sorted(set(ours) - set(theirs), key=repr)[:3], sorted(set(theirs) - set(ours), key=repr)[:3]
    return f"rows {len(ours)} vs {len(theirs)}; columns {sorted(names)}; only ours {extra}; only oracle {missing}"


def main(sf_dir: str, only: list[str]) -> int:
    from registry.oracles import ORACLES
    from registry.queries import QUERIES
    from threatspark.session import build_session

    spark, con, bad = build_session(), connect(sf_dir), 0
    for name in only or [n for n in QUERIES if n in ORACLES]:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
        except Exception as error:  # report every query, whatever it raises
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"\n{'BAD' if problem else 'ok '} {name} {time.time() - start:.1f}s {problem[:1500]}", flush=True)
    print(f"\n{bad} differ; without oracle: {[n for n in QUERIES if n not in ORACLES]}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
