"""Compare a query's rows with those of its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def views(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).iterdir()):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal | int | float):
        f = float(v)
        return None if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql: str):
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    r = con.execute(sql)
    want_names, want = [x[0] for x in r.description], r.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    a, b = rows(got_names, got), rows(want_names, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3] if len(a) < 50000 else []
        lost = [x for x in b if x not in set(a)][:3] if len(b) < 50000 else []
        return f"{len(a)} and {len(b)} rows; only in Spark {extra}; only in SQL {lost}"
    return ""
