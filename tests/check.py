"""Compare a registered query with its check SQL, the way the driver does."""

from __future__ import annotations

import math
import os

import duckdb

from querytide.registry import load

TESTDATA = os.environ.get("QUERYTIDE_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def check_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    spark_queries, check = load()
    df = spark_queries[name](spark, sf_dir)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in check:
        return "" if got else "no rows"
    cur = con.execute(check[name])
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows on either side"
    for g, w in zip(got, want):
        for n, x, y in zip(got_names, g, w):
            if x != y or type(x) is not type(y):
                return f"{n}: {x!r} != {y!r} in {g} / {w}"
    return ""
