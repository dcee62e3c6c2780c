"""Where queries are entered by name, with the survey ids they cover and the SQL they are checked against."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
OPS: dict[str, str] = {}


def query(ops: str, sql: str | None = None):
    def enter(f):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name], OPS[name] = f, ops
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f

    return enter
