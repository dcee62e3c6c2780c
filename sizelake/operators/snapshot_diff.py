"""Problem 4: what changed between consecutive full snapshots.

Full outer join on the primary key comparing hashes of canonical rows: a missing side is an addition or a removal, unequal
hashes are a change.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizelake.operators.ordering import dense_index
from sizelake.session import cut

LIST_KEY = "dinhCoHeThongContent"
ROW_KEY = "ma"


def _plain(v):
    """The value in canonical form: numbers by value, null properties out, the order of properties fixed when dumped."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int | float):
        f = float(v)
        return int(f) if f == f and abs(f) < 2**53 and f.is_integer() else v
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return {k: _plain(x) for k, x in v.items() if x is not None}


def row_hash(row: dict) -> bytes:
    """128 bits of the canonical row."""
    text = json.dumps(_plain(row), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def _parsed(text):
    """The list of sizing rows of a snapshot; None if the snapshot can't be parsed. An absent or null list is empty."""
    try:
        whole = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    rows = whole.get(LIST_KEY) if isinstance(whole, dict) else None
    for _ in range(2):  # JSON text, perhaps within JSON text
        if isinstance(rows, str):
            if not rows.strip():
                rows = None
                break
            try:
                rows = json.loads(rows)
            except (ValueError, RecursionError):
                return None
    if isinstance(whole, dict) and rows is None:
        return []
    if not isinstance(rows, list):
        return None
    return [r for r in rows if isinstance(r, dict) and r.get(ROW_KEY) is not None]


def _hashed(text) -> list[dict] | None:
    rows = _parsed(text)
    if rows is None:
        return None
    by: dict[str, list[bytes]] = {}
    for r in rows:
        key = r[ROW_KEY]
        key = key if isinstance(key, str) else json.dumps(_plain(key), sort_keys=True, ensure_ascii=False)
        by.setdefault(key, []).append(row_hash(r))
    # one entry per key: a key listed twice has the hash of its sorted, distinct rows
    return [{"ma": k, "h": v[0] if len(set(v)) == 1 else hashlib.sha256(b"".join(sorted(set(v)))).digest()[:16]} for k, v in by.items()]


ROWS = T.ArrayType(T.StructType([T.StructField("ma", T.StringType()), T.StructField("h", T.BinaryType())]))


@F.pandas_udf(ROWS)
def snapshot_rows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Per snapshot its rows' keys and hashes; null where the content can't be parsed."""
    for s in texts:
        yield pd.Series([_hashed(t) for t in s], dtype=object)


def full_snapshots(revisions: DataFrame) -> DataFrame:
    """(project_id, revision_id, created_at, rows): of several deliveries of an id the one received last, kept if it is a
    BASELINE or has no type and its content can be parsed. Deliveries received at one time: the greater content counts."""
    kind = F.coalesce(F.upper(F.trim("revision_type")), F.lit(""))
    r = revisions.where(F.col("id").isNotNull()).select(
        "id", "project_id", "created_at", "received_at", "revision_type", F.xxhash64("snapshot_content").alias("content"),
        # parsed where it is read, so that keys and hashes are shuffled and not the contents; evaluated once
        snapshot_rows.asNondeterministic()(F.when(kind.isin("BASELINE", ""), F.col("snapshot_content"))).alias("rows"),
    )
    last = r.groupBy("id").agg(
        # map-side combinable, so an id delivered very often is reduced before the shuffle
        F.max_by(F.struct("project_id", "created_at", "rows"), F.struct("received_at", "created_at", "content", "project_id", "revision_type")).alias("v")
    )
    return last.select("v.project_id", F.col("id").alias("revision_id"), "v.created_at", "v.rows").where("project_id is not null and rows is not null")


def snapshot_changes(revisions: DataFrame) -> DataFrame:
    """(revision_id, ma, change_type) for each consecutive pair of full snapshots of a project.

    Nulls: a row without id or project_id belongs to no project and is passed over; null created_at sorts first. Ties in
    created_at go by id. Repeated rows are one delivery. An empty table gives no rows. Extra columns are not read. A
    project may hold any share of the rows: snapshots are numbered by a global sort, and rows meet by (project, position,
    key)."""
    # written first, as heads and rows rest on it; only the heads are sorted
    snaps = cut(full_snapshots(revisions))
    heads = dense_index(snaps.drop("rows"), ["project_id", F.col("created_at").asc_nulls_first(), "revision_id"]).select("idx", "project_id", "revision_id")
    rows = snaps.select("revision_id", "rows").join(heads, "revision_id").select("idx", "project_id", F.explode("rows").alias("r")).select("idx", "project_id", "r.ma", "r.h")
    # a snapshot's rows count as `new` at its own place and as `old` at the next one, if that is of the same project
    new = rows.select("idx", "project_id", "ma", F.col("h").alias("new_h"))
    old = rows.select((F.col("idx") + 1).alias("idx"), "project_id", "ma", F.col("h").alias("old_h"))
    later = heads.join(
        heads.select((F.col("idx") + 1).alias("idx"), "project_id"), ["idx", "project_id"], "left_semi"
    )
    return (
        new.join(old, ["idx", "project_id", "ma"], "full_outer")
        .where(~F.col("new_h").eqNullSafe(F.col("old_h")))
        .join(later, ["idx", "project_id"])
        .select(
            "revision_id",
            "ma",
            F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").otherwise("changed").alias("change_type"),
        )
    )


def p4_found(spark, folder: str) -> DataFrame:
    from sizelake.sources.tables import table

    return snapshot_changes(table(spark, folder, "project_revisions"))


def p4_counts(spark, folder: str) -> DataFrame:
    """Changes per kind over the whole table."""
    return p4_found(spark, folder).groupBy("change_type").agg(F.count("*").alias("n"), F.countDistinct("revision_id").alias("revisions"))
