"""Runs a query on Spark and its SQL on DuckDB and compares the two results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", str(v))
    if isinstance(v, float):
        return ("x", "nan" if math.isnan(v) else repr(v + 0.0))
    return (type(v).__name__, str(v))


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(_plain(r[i]) for i in order) for r in rows])


def compare(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    got_names, got = _sorted(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_names, want = _sorted(names, cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} / {b}"
    return None if got else "no rows"
