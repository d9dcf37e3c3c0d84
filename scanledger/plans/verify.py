"""Compare a registered Spark query with its DuckDB oracle (column names, row count, row multiset)."""

from __future__ import annotations

import datetime as dt
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    sdf = fn(spark, sf_dir)
    srows = [r.asDict() for r in sdf.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    if sorted(sdf.columns) != sorted(dcols):
        return False, f"columns differ: spark={sdf.columns} duck={dcols}"
    cols = sorted(dcols)
    a, b = _rows(srows, cols), _rows(drows, cols)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"rows differ: spark={len(a)} duck={len(b)} spark-only={list(sa - sb)[:2]} duck-only={list(sb - sa)[:2]}"
    return True, f"{len(a)} rows"
