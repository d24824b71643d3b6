"""Side-by-side comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    return str(v)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    srows = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(dcols):
        return f"columns differ: {sorted(df.columns)} / {sorted(dcols)}"
    a, b = normal(srows, df.columns), normal(drows, dcols)
    if a == b:
        return None
    only_a = sorted(set(a) - set(b))[:4]
    only_b = sorted(set(b) - set(a))[:4]
    return f"{len(a)} / {len(b)} rows; {sorted(dcols)} spark only {only_a}; sql only {only_b}"
