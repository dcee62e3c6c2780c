"""Problem 6: texts laid into contexts of fixed capacity with as little room left as possible.

Variable-capacity best-fit: several permitted lengths are optimised jointly, each new context is opened at the length of
least cost per token laid into it, and in the end downsized to its contents. As only sizes matter for that, the plan is made
on the histogram of sizes, which has at most one entry per token of capacity however many texts there are; the texts then
take the places of their size in turn.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizelake.operators.ordering import dense_index
from sizelake.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public pre-tokenising pattern of byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 2048
LENGTHS = (512, 1024, 2048)
OVERHEAD = 16


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(path: str):
    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield s.map(lambda t: 0 if not t else len(enc.encode_ordinary(t)))

    return count.asNondeterministic()  # or a filter on the count would count again


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(number of contexts, length, [(size, how many)]) for sizes up to the greatest length; every item has one place.

    The largest size left opens a context. For each permitted length it is filled with the largest sizes that still fit; if
    room is left, the last items are exchanged for a better fit. The length of least cost (length and a fixed overhead) per
    token is opened, as often as the counts allow, so that the steps are bounded by the number of sizes."""
    top = max(lengths)
    count = np.zeros(top + 1, dtype=np.int64)
    for s, n in histogram.items():
        if not 0 < s <= top:
            raise ValueError(f"size {s} is not within the capacity")
        count[s] += n
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    sizes = np.flatnonzero(count)

    def largest(limit: int, used: dict[int, int]) -> int:
        i = int(np.searchsorted(sizes, limit, side="right")) - 1
        while i >= 0 and count[sizes[i]] - used.get(int(sizes[i]), 0) <= 0:
            i -= 1
        return int(sizes[i]) if i >= 0 else 0

    def fill(first: int, length: int) -> tuple[dict[int, int], int]:
        used, room, order = {first: 1}, length - first, [first]
        while room > 0 and (s := largest(room, used)):
            used[s] = used.get(s, 0) + 1
            order.append(s)
            room -= s
        if room > 0 and len(order) > 1:  # exchange the last item for two that fill the room better
            last = order[-1]
            used[last] -= 1
            best = (room, None)
            space = room + last
            for a in sizes[np.searchsorted(sizes, space // 2) : np.searchsorted(sizes, space, side="right")].tolist():
                if count[a] - used.get(a, 0) <= 0:
                    continue
                used[a] = used.get(a, 0) + 1
                b = largest(space - a, used)
                used[a] -= 1
                if space - a - b < best[0]:
                    best = (space - a - b, (a, b))
                    if best[0] == 0:
                        break
            if best[1] is None:
                used[last] += 1
            else:
                for x in best[1]:
                    if x:
                        used[x] = used.get(x, 0) + 1
                room = best[0]
        return {s: n for s, n in used.items() if n}, room

    while len(sizes):
        first = int(sizes[-1])
        options = []
        for length in sorted(lengths):
            if length >= first:
                used, room = fill(first, length)
                options.append(((length + overhead) / (length - room), length, used))
        _, length, used = min(options, key=lambda o: (o[0], -o[1]))
        times = min(int(count[s]) // n for s, n in used.items())
        for s, n in used.items():
            count[s] -= n * times
        held = sum(s * n for s, n in used.items())
        out.append((times, min(x for x in lengths if x >= held), sorted(used.items(), reverse=True)))
        sizes = sizes[count[sizes] > 0]
    return out


def places(patterns) -> dict[int, tuple[np.ndarray, ...]]:
    """size → arrays (first rank, items a context, first context, offset in the context, length), by rank."""
    by: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    context = 0
    for times, length, items in patterns:
        offset = 0
        for size, n in items:
            r = taken.get(size, 0)
            by.setdefault(size, []).append((r, n, context, offset, length))
            taken[size] = r + n * times
            offset += n * size
        context += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for s, rows in by.items()}


PLACE = T.StructType([T.StructField(n, T.LongType()) for n in ("context_id", "offset", "length")])


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> DataFrame:
    """(context_id, length, offset, doc_id, piece, from_token, n_tokens): where each text lies.

    A text within the capacity is one piece; a longer one is split into whole contexts and a rest. Null and empty texts have
    no tokens and no place. Rows are laid each, repeats too; ties of size are ordered by doc_id and piece. An empty table
    gives no rows. The driver gathers one count per size. Texts of one size may be any share of all rows: they are numbered
    by a global sort over all partitions."""
    if max(lengths) != capacity:
        raise ValueError("the greatest length is the capacity")
    sized = documents.where(F.length("text") > 0).select("doc_id", token_counts(tokenizer)("text").alias("n"))
    pieces = sized.where("n > 0").select(
        "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity)), lambda i: F.least(F.lit(capacity).cast("long"), F.col("n") - i * capacity))).alias("piece", "n_tokens")
    )
    # written first, as the range sort reads its input twice and the tokens would be counted twice
    ranked = dense_index(cut(pieces), ["n_tokens", F.col("doc_id").asc_nulls_first(), "piece"], "__idx")
    histogram = {r["n_tokens"]: r["n"] for r in ranked.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for s in sorted(histogram):
        starts[s] = total
        total += histogram[s]
    where = places(plan(histogram, lengths, overhead))

    @F.pandas_udf(PLACE)
    def place(sizes: pd.Series, idx: pd.Series) -> pd.DataFrame:
        s, i = sizes.to_numpy(), idx.to_numpy()
        out = np.zeros((len(s), 3), dtype=np.int64)
        for size in np.unique(s).tolist():
            at = np.flatnonzero(s == size)
            rank = i[at] - starts[size]
            first, n, context, offset, length = where[size]
            k = np.searchsorted(first, rank, side="right") - 1
            r = rank - first[k]
            out[at, 0] = context[k] + r // n[k]
            out[at, 1] = offset[k] + (r % n[k]) * size
            out[at, 2] = length[k]
        return pd.DataFrame(out, columns=["context_id", "offset", "length"])

    return ranked.withColumn("p", place("n_tokens", "__idx")).select(
        "p.context_id", "p.length", "p.offset", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).cast("long").alias("from_token"), "n_tokens"
    )


def p6_contexts(spark, folder: str) -> DataFrame:
    from sizelake.sources.tables import table

    return pack(table(spark, folder, "documents"))


def p6_fill(spark, folder: str) -> DataFrame:
    """Contexts, tokens and the share of their room that is used, by length."""
    per = p6_contexts(spark, folder).groupBy("context_id", "length").agg(F.sum("n_tokens").alias("tokens"))
    return per.groupBy("length").agg(F.count("*").alias("contexts"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("length")).alias("used"))
