"""Runs registered queries and compares them with their SQL on DuckDB: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, (list, tuple)) else str(x)) for x in r))


def connect(folder: str):
    db = duckdb.connect()
    for f in sorted(pathlib.Path(folder).glob("*.parquet")):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return db


def compare(df, db, sql: str) -> str | None:
    """None if equal, else what differs."""
    spark_columns, spark_rows = canonical_rows(df.columns, df.collect())
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_columns, duck_rows = canonical_rows(names, cursor.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} != {duck_columns}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    different = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(different)} of {len(spark_rows)} rows differ, e.g. {different[:2]}" if different else None


def main(folder: str, names: list[str]) -> int:
    from tallyglass.catalog import QUERIES, SQL
    from tallyglass.session import local_session

    spark, db, failed = local_session(8), connect(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in SQL:
                problem = compare(df, db, SQL[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        kind = "sql " if name in SQL else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    where = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    sys.exit(bool(main(where, arguments)))
