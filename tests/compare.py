"""Run registered queries and compare them with their SQL in DuckDB.

As a script: ``python -m tests.compare [sf_dir] [name ...]``.
"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def compare(spark, connection, sf_dir: str, run, sql: str) -> str | None:
    """None on equal results, else what differs."""
    df = run(spark, sf_dir)
    ours = sorted_rows(df.columns, df.collect())
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    theirs = sorted_rows(names, relation.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        a, b = (repr(row)[:600] for row in different[0])
        return f"{len(different)} rows differ, first:\n  spark {a}\n  sql   {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from duelframe import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    sql = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if name in sql:
                problem = compare(spark, connection, sf_dir, run, sql[name])
            else:
                problem = None if run(spark, sf_dir).count() >= 0 else "no result"
        except Exception as error:  # reported, not hidden
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
