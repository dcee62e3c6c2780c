"""Matching in passes, and order-dependent operators over small groups."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizelake.operators.ordering import dense_index
from sizelake.session import cut


def rank_in_key(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the place (from 1) of each row among those of its key, for keys of any size: a global index less the key's
    first one. Null keys are keys of their own."""
    ranked = dense_index(df, [*keys, *order], "__i").withColumn("__k", F.struct(*keys))
    first = ranked.groupBy("__k").agg(F.min("__i").alias("__f"))
    return ranked.join(first, "__k").withColumn(name, F.col("__i") - F.col("__f") + 1).drop("__k", "__i", "__f")


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list[list[str]]) -> DataFrame:
    """(left_id, right_id, pass): greedy one-to-one pairs. In each pass what is still free on both sides is paired by equal
    keys, the first with the first, the second with the second; then the next, looser keys are tried. Rows with a null in a
    pass's key wait for a later pass. Ids must be unique on their side."""
    out = None
    for no, keys in enumerate(passes, 1):
        some = " and ".join(f"{k} is not null" for k in keys)
        a = rank_in_key(left.where(some).select(left_id, *keys), keys, [left_id])
        b = rank_in_key(right.where(some).select(right_id, *keys), keys, [right_id])
        pairs = cut(a.join(b, [*keys, "rank"]).select(left_id, right_id, F.lit(no).alias("pass")))
        left, right = left.join(pairs, left_id, "left_anti"), right.join(pairs, right_id, "left_anti")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def first_fit(df: DataFrame, group: str, order: str, words: str, least: float = 0.6, most_rounds: int = 100) -> DataFrame:
    """(group, order, first): within each group, in order, a row joins the first cluster whose first member's words are alike
    (Jaccard of at least `least`), else begins one; first is the order value of that member, its own for one that begins.

    A row begins a cluster if and only if no cluster's first member before it is like it, so that the order matters between
    like rows only: pairs of like rows come from a join on rare words (two sets that are alike share one of the rarest
    |a| - ceil(least |a|) + 1 words of each), then, round by round, rows whose earlier likes are all decided are decided.
    No group is gathered. Rows without words, null or empty, are like each other and like nothing else; (group, order) must
    be unique; null groups or orders are passed over."""
    every = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.array_sort(F.array_distinct(F.coalesce(F.array_compact(words), F.array().cast("array<string>")))).alias("w")).where("g is not null and o is not null")
    every = cut(every.withColumns({"k1": F.xxhash64("w"), "k2": F.xxhash64(F.lit(2), "w")}))
    # rows of equal words fare like the first of them: only these are compared
    x = cut(every.groupBy("g", "k1", "k2").agg(F.min("o").alias("o"), F.min_by("w", "o").alias("w")))
    n = x.select("g", F.explode("w").alias("t")).groupBy("g", "t").agg(F.count("*").alias("n"))
    rare = x.select("g", "o", F.size("w").alias("size"), F.explode("w").alias("t")).join(n, ["g", "t"]).groupBy("g", "o", "size").agg(F.sort_array(F.collect_list(F.struct("n", "t")))["t"].alias("ts"))  # the words of one row
    keys = rare.select("g", "o", F.explode(F.slice("ts", 1, (F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1).cast("int"))).alias("t"))
    pairs = keys.select("g", "t", F.col("o").alias("a")).join(keys.select("g", "t", F.col("o").alias("b")), ["g", "t"]).where("a < b").select("g", "a", "b").distinct()
    side = lambda o, w: x.select("g", F.col("o").alias(o), F.col("w").alias(w))
    like = pairs.join(side("a", "wa"), ["g", "a"]).join(side("b", "wb"), ["g", "b"]).where(F.size(F.array_intersect("wa", "wb")) >= F.lit(least) * F.size(F.array_union("wa", "wb")) - 1e-9)
    like = cut(like.select("g", "a", "b"))
    done = cut(x.select("g", "o").join(like.select("g", F.col("b").alias("o")).distinct(), ["g", "o"], "left_anti").select("g", "o", F.col("o").alias("first")))
    open_rows = cut(x.select("g", "o").join(done, ["g", "o"], "left_anti"))
    for _ in range(most_rounds):
        if open_rows.isEmpty():
            of = x.select("g", "k1", "k2", "o").join(done, ["g", "o"]).select("g", "k1", "k2", "first")
            return every.select("g", "o", "k1", "k2").join(of, ["g", "k1", "k2"]).select(F.col("g").alias(group), F.col("o").alias(order), "first")
        # for each open row: the least of its likes that begins a cluster, and whether an earlier one is open still
        near = like.join(open_rows.select("g", F.col("o").alias("b")), ["g", "b"])
        near = near.join(done.select("g", F.col("o").alias("a"), F.col("first").alias("of")), ["g", "a"], "left")
        s = near.groupBy("g", "b").agg(F.min(F.when(F.col("of") == F.col("a"), F.col("a"))).alias("hit"), F.min(F.when(F.col("of").isNull(), F.col("a"))).alias("waits"))
        new = s.where("waits is null or hit < waits").select("g", F.col("b").alias("o"), F.coalesce("hit", "b").alias("first"))
        done = cut(done.unionByName(new))
        open_rows = cut(open_rows.join(done, ["g", "o"], "left_anti"))
    raise RuntimeError(f"not decided after {most_rounds} rounds")


#: Items that are matched in one pass over the candidates.
BLOCK_ITEMS = 20_000
LEAST_SHARED = 2  # fixed value: one shared word is chance


def best_by_words(candidates: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, score, f1, text, exact): for each item the candidate whose words fit it best.

    candidates: (text, weight, words, plain), items: (item, words, head, plain); words are sets, plain the same without
    accents, head the item's first words. F1 of the words, or of the head if that is more, times the candidate's weight; at
    least two words must be shared. Where fewer are, the words without accents count, which is not exact. Ties go to the
    lesser text. Every candidate is looked at once for each block of items, against their index of words, and a task hands on
    one candidate an item: no pairs are shuffled, whatever words are common. Null texts, and items without words, match
    nothing; items that match nothing have no row."""
    rows = items.select("item", "words", "head", "plain").where("item is not null and size(words) > 0")
    count = rows.count()
    blocks = max(1, -(-count // block_items))
    schema = "item bigint, score double, f1 double, text string, exact boolean"
    found = candidates.sparkSession.createDataFrame([], schema)
    for k in range(blocks):
        own = sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect())
        if own:
            found = found.unionByName(candidates.select("text", "weight", "words", "plain").where("text is not null and size(words) > 0").mapInPandas(_best_of(own), schema))
    best = found.groupBy("item").agg(F.min(F.struct((-F.col("score")).alias("m"), "text", "f1", "exact")).alias("b"))
    return best.select("item", (-F.col("b.m")).alias("score"), "b.f1", "b.text", "b.exact")


def _best_of(own: list[tuple]):
    def index(column: int):
        held: dict[str, list[int]] = {}
        for i, r in enumerate(own):
            for w in set(r[column]):
                held.setdefault(w, []).append(i)
        return {w: np.array(v) for w, v in held.items()}, np.array([len(set(r[column])) for r in own])

    sides = [index(c) for c in (1, 2, 3)]
    n = len(own)

    def shared(words, side):
        held = [h for w in words if (h := sides[side][0].get(w)) is not None]
        return np.bincount(np.concatenate(held), minlength=n) if held else None

    def f1(k, size, side):
        return np.where(k > 0, 2.0 * k / (size + sides[side][1]), 0.0)

    def look(batches):
        for pdf in batches:
            best, text, rate, sure = np.full(n, -1.0), [None] * n, np.zeros(n), np.zeros(n, dtype=bool)
            for t, weight, words, plain in zip(pdf["text"], pdf["weight"], pdf["words"], pdf["plain"], strict=True):
                bare = shared(plain, 2)
                if bare is None or bare.max() < LEAST_SHARED:
                    continue  # words with accents share no more than those without
                k, h = shared(words, 0), shared(words, 1)
                whole = f1(k, len(words), 0) if k is not None else np.zeros(n)
                head = f1(h, len(words), 1) if h is not None else np.zeros(n)
                k, h = (np.zeros(n, dtype=int) if x is None else x for x in (k, h))
                use = head > whole
                r, c = np.where(use, head, whole), np.where(use, h, k)
                exact = c >= LEAST_SHARED
                r = np.where(exact, r, np.where(bare >= LEAST_SHARED, f1(bare, len(plain), 2), -1.0))
                score = np.where(r > 0, np.round(r * weight, 6), -1.0)
                for i in np.flatnonzero((score > best) | ((score == best) & (score > 0))):
                    if score[i] > best[i] or t < text[i]:
                        best[i], text[i], rate[i], sure[i] = score[i], t, r[i], exact[i]
            hit = np.flatnonzero(best > 0)
            yield pd.DataFrame({"item": [own[i][0] for i in hit], "score": best[hit], "f1": rate[hit], "text": [text[i] for i in hit], "exact": sure[hit]}).astype({"text": object})

    return look


BLOCKS = T.StructType([T.StructField(n, k) for n, k in (("ratio", T.DoubleType()), ("inserted", T.IntegerType()), ("deleted", T.IntegerType()), ("replaced", T.IntegerType()))])


def _blocks(a: str | None, b: str | None):
    if a is None or b is None:
        return (None,) * 4
    x, y = ([s for s in ("".join(line.split()) for line in t.splitlines()) if s] for t in (a, b))
    m = difflib.SequenceMatcher(None, x, y, autojunk=False)
    n = {"insert": 0, "delete": 0, "replace": 0}
    for tag, *_ in m.get_opcodes():
        if tag in n:
            n[tag] += 1
    return m.ratio(), n["insert"], n["delete"], n["replace"]


@F.pandas_udf(BLOCKS)
def sequence_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Blocks by which two texts differ, line by line, blanks aside."""
    return pd.DataFrame([_blocks(x, y) for x, y in zip(a, b, strict=True)], columns=BLOCKS.names)


def balanced(sizes: list[tuple[str, int]], bins: list[str]) -> dict[str, str]:
    """Greedy assignment of groups to bins, largest first to the bin with least; for a short list on the driver."""
    held = dict.fromkeys(bins, 0)
    out = {}
    for k, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        b = min(bins, key=lambda x: (held[x], bins.index(x)))
        held[b] += n
        out[k] = b
    return out
