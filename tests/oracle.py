"""Run a registered query and its check SQL on the same parquet files and compare the rows."""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "-0.0!" if repr(v) == "-0.0" else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return True, f"{len(got)} rows"
    a, b = set(got), set(want)
    left, right = sorted(a - b)[:3], sorted(b - a)[:3]
    return False, f"rows {len(got)} vs {len(want)}, only spark {len(a - b)}:\n  {left}\n only sql {len(b - a)}:\n  {right}\n  {sorted(names)}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from marketpulse.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    todo = sys.argv[1:] or list(e.queries())
    bad = []
    for key in todo:
        t = time.time()
        try:
            if key in e.oracle_sql():
                ok, note = compare(spark, con, sf, e.queries()[key], e.oracle_sql()[key])
            else:
                rows = e.queries()[key](spark, sf).collect()
                ok, note = True, f"{len(rows)} rows (no SQL): {rows[:2]}"
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(("ok  " if ok else "FAIL"), key, f"{time.time() - t:.1f}s", note, flush=True)
        if not ok:
            bad.append(key)
    print("bad:", bad)
