"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """None if both give the same columns and multiset of rows, else what differs."""
    got_cols = sorted(df.columns)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    if got_cols != sorted(want_cols):
        return f"columns {got_cols} != {sorted(want_cols)}"
    want = [tuple(_norm(r[want_cols.index(c)]) for c in got_cols) for r in cur.fetchall()]
    got = [tuple(_norm(v) for v in r) for r in df.select(*got_cols).collect()]
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    key = lambda t: tuple((x is None, str(x)) for x in t)
    got.sort(key=key), want.sort(key=key)
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{got_cols}: {g} != {w}"
    if got and [type(x) for x in got[0] if x is not None] != [type(x) for x in want[0] if x is not None]:
        return "types differ"
    return None
