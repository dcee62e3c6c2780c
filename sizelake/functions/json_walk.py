"""All leaves of JSON of unknown depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def leaves(text: str | None) -> list[dict] | None:
    """(path, kind, value) of each leaf in order, without recursion in Python; None for what is no JSON."""
    if text is None:
        return None
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return None
    out, todo = [], [("$", root)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "text"
            out.append({"path": path, "kind": kind, "value": None if v is None else v if isinstance(v, str) else json.dumps(v)})
    return out


@F.pandas_udf(LEAVES)
def json_leaves(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([leaves(t) for t in s], dtype=object)


def canonical(c: Column) -> Column:
    """JSON with the properties of every object in order and without blanks; null for null and for what is no JSON."""
    return F.to_json(F.try_parse_json(c))


def canonical_hash(c: Column) -> Column:
    """SHA-256 of the canonical form, so that objects that differ in order or blanks only have one hash."""
    return F.sha2(F.encode(canonical(c), "UTF-8"), 256)
