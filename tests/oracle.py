"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canon(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(spark, con, f, sql: str, d: str) -> str:
    df = f(spark, d)
    mine = rows(df.columns, df.collect())
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    return f"{len(bad)} rows differ: {str(bad[0])[:300]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import session

    from tessera.queries import ORACLE_SQL, QUERIES

    d, only = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(d)
    good = 0
    for name, f in QUERIES.items():
        if only and name not in only:
            continue
        try:
            said = compare(spark, con, f, ORACLE_SQL[name], d) if name in ORACLE_SQL else ("" if f(spark, d).count() >= 0 else "")
        except Exception as e:
            said = f"{type(e).__name__} {str(e)[:400]}"
        good += not said
        if said:
            print(name, said, flush=True)
    print(good, "good of", len(only or QUERIES))
