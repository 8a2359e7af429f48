"""Run registered queries in Spark and DuckDB on the same parquet tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, db, folder: str, function, sql: str | None):
    """(problem or None, rows, spark seconds, duckdb seconds)"""
    start = time.time()
    df = function(spark, folder)
    mine = rows_of(df.columns, df.collect())
    middle = time.time()
    n = sum(mine[1].values())
    if sql is None:
        return None, n, middle - start, 0.0
    cursor = db.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    end = time.time()
    problem = None
    if mine[0] != theirs[0]:
        problem = f"columns {mine[0]} != {theirs[0]}"
    elif mine[1] != theirs[1]:
        extra, lost = list((mine[1] - theirs[1]).items()), list((theirs[1] - mine[1]).items())
        problem = (
            f"rows {n} vs {sum(theirs[1].values())}; only spark {len(extra)} {extra[:2]}; "
            f"only duckdb {len(lost)} {lost[:2]}"
        )
    return problem, n, middle - start, end - middle


def main(folder: str, only: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tallyframe.session import local_session

    limit = os.environ.get("MAX_ROWS_PER_KEY")
    conf = {"spark__tallyframe__maxRowsPerKey": limit} if limit else {}
    spark, db, bad = local_session(8, **conf), connect(folder), 0
    sqls = oracle_sql()
    for name, function in queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            problem, n, a, b = compare(spark, db, folder, function, sqls.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem, n, a, b = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0, 0.0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:28s} rows={n:<8d} spark={a:.2f}s duckdb={b:.2f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
