"""Run queries in Spark and their SQL in DuckDB on the same tables and compare all rows.

``python tests/differential.py [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docloom import plans  # noqa: E402
from docloom.plans.relational import TABLES  # noqa: E402

DEFAULT = "/root/testdata/sf0.01"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(columns: list[str], rows: list) -> list[tuple]:
    """Rows as text tuples, columns sorted by name, rows sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    df = plans.QUERIES[name](spark, folder)
    start = time.time()
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in plans.ORACLES:
        return True, f"{len(mine)} rows, no SQL"
    start = time.time()
    cursor = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = normal(columns, cursor.fetchall())
    sql_time = time.time() - start
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    if mine != theirs:
        a = [r for r in mine if r not in set(theirs)][:2]
        b = [r for r in theirs if r not in set(mine)][:2]
        return False, f"{len(mine)} rows against {len(theirs)}\n   spark only {str(a)[:1500]}\n   sql only   {str(b)[:1500]}"
    kinds = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    sql_kinds = sorted((c[0], str(c[1])) for c in cursor.description)
    return True, f"{len(mine)} rows, {spent:.1f}s, sql {sql_time:.1f}s {[k for _, k in kinds]} {[k for _, k in sql_kinds]}"


if __name__ == "__main__":
    from docloom.session import get_spark

    folder = sys.argv[1] if len(sys.argv) > 1 else DEFAULT
    names = sys.argv[2:] or list(plans.QUERIES)
    spark, con = get_spark(cores=8), connect(folder)
    bad = 0
    for n in names:
        try:
            ok, told = compare(spark, con, n, folder)
        except Exception as e:  # noqa: BLE001
            ok, told = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, told, flush=True)
    print(f"{len(names) - bad} of {len(names)} match")
