"""Runs registered queries and their SQL on the same tables and compares names, rows and values.

usage: python tests/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}" if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description; also the seconds both sides took."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return (None, len(got), t1 - t0, 0.0)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return (f"columns {sorted(df.columns)} != {sorted(names)}", len(got), t1 - t0, t2 - t1)
    kinds = lambda cols, rows: {c: {type(r[i]).__name__ for r in rows if r[i] is not None} for i, c in enumerate(cols)}
    ka, kb = kinds(df.columns, got), kinds(names, want)
    if got and want and ka != kb:
        return (f"types { {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]} }", len(got), t1 - t0, t2 - t1)
    a, b = canonical(df.columns, got), canonical(names, want)
    problem = None
    if len(a) != len(b):
        problem = f"rows {len(a)} != {len(b)}"
    elif a != b:
        x, y = next((x, y) for x, y in zip(a, b) if x != y)
        problem = f"{sum(x != y for x, y in zip(a, b))} rows differ, first {x} != {y}"[:600]
    return problem, len(got), t1 - t0, t2 - t1


def main(sf_dir="/root/testdata/sf0.01", *prefixes):
    import __spark_entry__ as entry
    from signalbook.session import local_session

    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            problem, n, ts, td = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            problem, n, ts, td = f"{type(e).__name__}: {str(e)[:700]}", -1, 0, 0
        bad += problem is not None
        kind = "ok" if problem is None else "BAD"
        print(f"{kind:4}{name:36} rows={n:<7} spark={ts:6.1f}s duckdb={td:6.1f}s {'(rows only)' if name not in sqls else ''} {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(*sys.argv[1:]), 1))
