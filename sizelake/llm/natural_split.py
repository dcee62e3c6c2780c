"""Problem 5: pieces of oversized texts, cut at natural boundaries.

Dynamic programming over boundary positions minimises the cut penalties and the imbalance of sizes, subject to the greatest
length and the overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 2000, 200
# fixed values: what a cut behind the match costs, best first
BOUNDARIES = (
    (re.compile(r"\n[ \t]*\n\s*"), 0.0),
    (re.compile(r"\n+[ \t]*"), 0.5),
    (re.compile(r"[.!?…]+[\"')\]»”]*\s+"), 1.0),
    (re.compile(r"[;:]\s+"), 2.0),
    (re.compile(r"[,|)\]}]\s*"), 3.0),
    (re.compile(r"\s+"), 6.0),
)
HARD = 60.0
STEP = 50


def boundaries(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted positions of possible cuts (0 and the end included), their penalties, and the positions where an overlap may
    begin. A weaker kind of boundary counts only in gaps longer than half the room that stronger ones leave; where no
    natural boundary comes for so long, hard ones stand in the gap, before a combining mark only if marks fill the room."""
    n = len(text)
    room = max(1, (limit - overlap) // 2)
    cost = {0: 0.0, n: 0.0}
    begins = set(cost)
    for pattern, c in BOUNDARIES:
        found = [m.end() for m in pattern.finditer(text)]
        begins.update(found)
        if c <= 1.0:
            for e in found:
                cost.setdefault(e, c)
            continue
        at = sorted(cost)
        wide = [(p, q) for p, q in zip(at, at[1:], strict=False) if q - p > room]
        if wide:
            found_at = np.array(found, dtype=np.int64)
            for p, q in wide:
                for e in found_at[np.searchsorted(found_at, p, side="right") : np.searchsorted(found_at, q, side="left")].tolist():
                    cost.setdefault(e, c)
    at = sorted(cost)
    step = max(1, min(STEP, room))
    for p, q in zip(at, at[1:], strict=False):
        if q - p > room:
            last = p
            for e in range(p + step, q, step):
                while e < q and e - last < room and (unicodedata.combining(text[e]) or text[e] in "\u200d\ufe0e\ufe0f"):
                    e += 1
                if last < e < q:
                    cost.setdefault(e, HARD)
                    last = e
    pos = np.array(sorted(cost), dtype=np.int64)
    return pos, np.array([cost[p] for p in pos.tolist()]), np.array(sorted(begins | set(cost)), dtype=np.int64)


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, new_from, end) of each piece: the piece is text[start:end], of which text[start:new_from] repeats the end of
    the piece before. A text within the limit is one piece. Joined, the parts from new_from on are the text."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    pos, pen, begins = boundaries(text, limit, overlap)
    k = len(pos)
    # a piece behind a cut at pos[i] starts at the earliest boundary within the overlap (at the cut itself if there is none)
    starts = begins[np.searchsorted(begins, pos - overlap, side="left")]
    starts[0] = 0
    body = max(1, limit - overlap)
    target = n / max(1, -(-n // body))
    best = np.full(k, np.inf)
    best[0] = 0.0
    back = np.zeros(k, dtype=np.int64)
    for j in range(1, k):
        i0 = int(np.searchsorted(pos, pos[j] - limit, side="left"))
        i = np.arange(i0, j)
        i = i[pos[j] - starts[i] <= limit]
        if not len(i):
            continue
        off = (pos[j] - pos[i] - target) / target
        cost = best[i] + pen[j] + 8.0 * off * off + 2.0
        b = int(np.argmin(cost))
        best[j], back[j] = cost[b], i[b]
    cuts, j = [], k - 1
    while j > 0:
        cuts.append((int(starts[back[j]]), int(pos[back[j]]), int(pos[j])))
        j = int(back[j])
    return cuts[::-1]


PIECES = T.ArrayType(
    T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("new_from", T.IntegerType()), T.StructField("text", T.StringType())])
)


def split_texts(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the columns of df without `text`, and piece (from 0), start, new_from, piece_text, pieces.

    Lengths are Unicode code points. Null texts have no piece, empty ones one empty piece; texts within the limit pass by
    Python unread. Repeated rows are cut each; other columns are carried along, those with one of
    the new names are replaced."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    new = {"piece", "start", "new_from", "piece_text", "pieces"}
    keep = [c for c in df.columns if c != text and c not in new]
    df = df.select(F.struct(*[F.col(c) for c in keep]).alias("row") if keep else F.struct(F.lit(1).alias("_")).alias("row"), F.col(text).alias("text"))

    @F.pandas_udf(PIECES)
    def cut_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else [{"piece": i, "start": a, "new_from": b, "text": t[a:e]} for i, (a, b, e) in enumerate(cut_text(t, limit, overlap))] for t in s], dtype=object)

    long = df.where(F.length("text") > limit).select("row", cut_all.asNondeterministic()(F.col("text")).alias("p"))
    short = df.where(F.length("text") <= limit).select(
        "row", F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(0).alias("new_from"), F.col("text").alias("text"))).alias("p")
    )
    out = long.unionByName(short).select("row", F.size("p").alias("pieces"), F.explode("p").alias("p"))
    return out.select(*(["row.*"] if keep else []), "p.piece", "p.start", "p.new_from", F.col("p.text").alias("piece_text"), "pieces")


def _texts(spark, folder: str) -> DataFrame:
    """(field, record_id, text), each once."""
    from sizelake.sources.tables import table

    e = table(spark, folder, "elements").select(F.lit("elements.text").alias("field"), F.concat("doc_id", F.lit("#"), F.col("element_index").cast("string")).alias("record_id"), "text")
    p = table(spark, folder, "project_data")
    q = [p.select(F.lit(f"project_data.{c}").alias("field"), F.col("id").alias("record_id"), F.col(c).alias("text")) for c in ("mo_hinh_he_thong_content", "dinh_co_he_thong_content")]
    return e.unionByName(q[0]).unionByName(q[1])


def p5_pieces(spark, folder: str) -> DataFrame:
    """The pieces of every text above the limit; a row delivered twice is cut once."""
    # only the few long texts are compared for being repeats
    return split_texts(_texts(spark, folder).where(F.length("text") > LIMIT).distinct())


def p5_found(spark, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).where("pieces > 1").select("field", "record_id").distinct()
