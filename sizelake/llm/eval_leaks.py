"""Problem 7: evaluation texts inside training text.

Rare n-gram seeds join documents to test items, then Smith-Waterman alignment over words scores whole, partial and edited
copies. The seeds are chosen so that none is missed: of the n-grams in every window of `window` words of an item the one rarest
in the corpus is a seed, so any `window` (6) consecutive words of an item that stand in a document hit a seed: every passage of 8 words, which alone
makes a result, and copies with every seventh word edited.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sizelake.functions import unicode_forms as U
from sizelake.session import cut

GRAM, RUN, WINDOW = 4, 12, 6
#: Words of held-out items that are looked for in one pass over the documents.
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_FOREIGN = re.compile(U.FOREIGN)
_LOOKALIKE = str.maketrans(U.LOOKALIKES)
# fixed values: signs outside ASCII that part words or have an ASCII twin; what is left outside ASCII once letters are
# decomposed (accents, invisible signs) is dropped within a word
_PLAIN = {"đ": "d", "Đ": "d", "Ð": "d", "Ɖ": "d", "\u2013": " ", "\u2014": " ", "\u2019": "'", "\u2018": "'", "\u2026": " ", "\u00b7": " ", "\u2022": " ", "\u00d7": " "}
_SPLIT = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in b"".join([bytes(range(256))]).lower())


def words(text: str) -> list[bytes]:
    """Words without case, accents, punctuation, line marks and other character forms."""
    if text.isascii():
        return text.encode().translate(_SPLIT).split()
    for c, plain in _PLAIN.items():
        if c in text:
            text = text.replace(c, plain)
    text = unicodedata.normalize("NFKD", text)
    if _FOREIGN.search(text):
        text = text.translate(_LOOKALIKE)
    return text.encode("ascii", "ignore").translate(_SPLIT).split()


#: Words of items, over all pairs, that a batch of alignments holds: as many as stay in a core's cache.
BATCH_WORDS = 262_144
#: Pairs that a task gathers before it aligns them.
MOST_PAIRS = 200_000
#: A window longer than this is cut into overlapping ones.
MOST_WINDOW = 4_096


def _stacked(arrays: list[np.ndarray], empty: int, dtype, backwards: bool = False) -> np.ndarray:
    """The arrays as columns; what is not there is `empty`."""
    out = np.full((max(map(len, arrays)), len(arrays)), empty, dtype=dtype)
    for k, a in enumerate(arrays):
        out[: len(a), k] = a
    return np.ascontiguousarray(out[::-1]) if backwards else out


def _sides(pairs) -> tuple[np.ndarray, np.ndarray]:
    """The texts, last word first, and the items, a column a pair. Ids of 0 and what is padded match nothing."""
    doc, item = _stacked([a for a, _ in pairs], 0, np.uint32, backwards=True), _stacked([b for _, b in pairs], 0, np.uint32)
    none = np.uint32(np.iinfo(np.uint32).max)
    item[item == 0] = none
    if int(doc.max(initial=0)) < 65_535 and int(item.max(initial=0, where=item < none)) < 65_535:
        return doc.astype(np.uint16), item.astype(np.uint16)  # what matches nothing keeps all its bits
    return doc, item


def _diagonals(n: int, m: int) -> Iterator[tuple[int, int, int]]:
    """(d, lowest and highest place in the item) of the diagonals of a matrix of n by m; the place in the text is d less that
    in the item, both from 1."""
    for d in range(2, n + m + 1):
        yield d, max(1, d - n), min(m, d - 1)


def scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The score of the best local alignment of each pair of word-id arrays. Smith-Waterman by diagonals: the cells of a
    diagonal rest on the two before only, so that each is a few sweeps over all pairs at once, in the shortest integers that
    hold the scores. Scores lie above a floor, so that a byte holds those of items of up to 120 words."""
    doc, item = _sides(pairs)
    (n, p), m = doc.shape, len(item)
    kind, floor = (np.int8, -126) if m <= 120 else (np.int16, 0) if m < 16_000 else (np.int32, 0)
    ground = np.full((m + 1, p), floor, dtype=kind)
    one, two, now = ground.copy(), ground.copy(), ground.copy()  # the diagonal before, the one before that, this one
    same, best = np.empty((m, p), dtype=bool), ground[0].copy()
    for d, lo, hi in _diagonals(n, m):
        k = hi - lo + 1
        eq, cell = same[:k], now[lo : hi + 1]
        np.equal(doc[n - d + lo : n - d + hi + 1], item[lo - 1 : hi], out=eq)
        np.multiply(eq.view(np.int8), kind(MATCH - MISMATCH), out=cell)
        cell += two[lo - 1 : hi]
        cell += kind(MISMATCH)
        one += kind(GAP)
        np.maximum(cell, one[lo : hi + 1], out=cell)
        np.maximum(cell, one[lo - 1 : hi], out=cell)
        np.maximum(cell, ground[:k], out=cell)
        one -= kind(GAP)
        np.maximum(best, cell.max(axis=0), out=best)
        one, two, now = now, one, two
    return best.astype(np.int64) - floor


def placed(pairs: list[tuple[np.ndarray, np.ndarray]], known: np.ndarray) -> list[tuple[int, int, int]]:
    """(score, start and end in the first) of the best alignment of each pair, whose scores are known: as
    `scores`, but a cell holds, below its score, how early its alignment began, so that the start comes along, and cells that
    reach the known score are looked up. Of several the one that ends first in the item counts, there the one that ends first
    in the text, and of these the one that begins first."""
    doc, item = _sides(pairs)
    (n, p), m = doc.shape, len(item)
    bits = int(n + 1).bit_length()
    kind = next(t for t in (np.int16, np.int32, np.int64) if (MATCH * m + 4) << bits < np.iinfo(t).max)
    unit, mask = 1 << bits, (1 << bits) - 1
    # score 0, begun at the cell's own place in the text: mask - (d - j)
    fresh = np.repeat((mask - 1 + np.arange(m + 1)).astype(kind)[:, None], p, axis=1)  # as of the diagonal before the first
    one, two, now = (np.full((m + 1, p), mask, dtype=kind) for _ in range(3))
    same = np.empty((m, p), dtype=bool)
    goal = (known.astype(kind) << bits)[None, :]
    reach = np.repeat(np.where(goal > 0, goal, np.iinfo(kind).max), m, axis=0).astype(kind)
    found: list[tuple[int, int, int] | None] = [None] * p  # (place in the item, in the text, start)
    one[0] = mask - 1
    for d, lo, hi in _diagonals(n, m):
        k = hi - lo + 1
        eq, cell = same[:k], now[lo : hi + 1]
        np.equal(doc[n - d + lo : n - d + hi + 1], item[lo - 1 : hi], out=eq)
        np.multiply(eq, kind((MATCH - MISMATCH) * unit), out=cell)
        cell += two[lo - 1 : hi]
        cell += kind(MISMATCH * unit)
        one += kind(GAP * unit)
        np.maximum(cell, one[lo : hi + 1], out=cell)
        np.maximum(cell, one[lo - 1 : hi], out=cell)
        one -= kind(GAP * unit)
        fresh -= kind(1)
        np.maximum(cell, fresh[lo : hi + 1], out=cell)
        now[0] = mask - d
        np.greater_equal(cell, reach[:k], out=eq)
        if eq.any():
            for j, q in zip(*np.nonzero(eq), strict=True):
                place = (lo + int(j), d - lo - int(j))
                if found[q] is None or place < found[q][:2]:
                    found[q] = (*place, mask - (int(cell[j, q]) & mask))
        one, two, now = now, one, two
    return [(int(v), f[2], f[1]) if f else (0, 0, 0) for v, f in zip(known, found, strict=True)]


def runs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The longest run of words that each pair shares."""
    doc, item = _sides(pairs)
    (n, p), m = doc.shape, len(item)
    kind = next(t for t in (np.int8, np.int16, np.int32) if m < np.iinfo(t).max)
    one, two, now = (np.zeros((m + 1, p), dtype=kind) for _ in range(3))
    same, longest = np.empty((m, p), dtype=bool), np.zeros(p, dtype=kind)
    for d, lo, hi in _diagonals(n, m):
        eq, cell = same[: hi - lo + 1], now[lo : hi + 1]
        np.equal(doc[n - d + lo : n - d + hi + 1], item[lo - 1 : hi], out=eq)
        np.add(two[lo - 1 : hi], kind(1), out=cell)
        cell *= eq
        np.maximum(longest, cell.max(axis=0), out=longest)
        one, two, now = now, one, two
    return longest.astype(np.int64)


def spans(own: list[np.ndarray], other: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in `own` an alignment of at least the score can lie: a word that `other` has adds a match at best, any other costs
    at least one, so that the words of the alignment add up to its score or more. Words are looked up by hash; a collision
    makes a span wider, never narrower."""
    a, b = _stacked(own, 0, np.uint64), _stacked(other, 0, np.uint64)
    column, bits = np.arange(a.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
    place = lambda x: ((x * np.uint64(0xC2B2AE3D27D4EB4F) + column) * np.uint64(0x9E3779B97F4A7C15)) >> bits
    held = np.zeros(1 << 20, dtype=bool)
    held[place(b)] = True
    total = np.zeros((len(a) + 1, a.shape[1]), dtype=np.int32)
    np.cumsum(np.where(held[place(a)] & (a > 0), MATCH, max(MISMATCH, GAP)), axis=0, out=total[1:])
    after = np.maximum.accumulate(total[::-1], axis=0)[::-1]
    before = np.minimum.accumulate(total, axis=0)
    return (after >= total + least).argmax(axis=0), len(a) - (total >= before + least)[::-1].argmax(axis=0)


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]], least: int = 0) -> list[tuple[int, int, int, int] | None]:
    """(score, start, end, longest run) of each pair, None where the score is below `least`: scores first, places only where
    they are asked for. Pairs are taken in batches of like length and of bounded size."""
    out: list = [None] * len(pairs)
    best = np.zeros(len(pairs), dtype=np.int64)
    order = sorted((k for k, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda k: (len(pairs[k][0]) // 8, len(pairs[k][1])))
    for part in _batches(order, pairs, BATCH_WORDS):
        best[part] = scores([pairs[k] for k in part])
    hits = [k for k in order if best[k] >= max(least, 1)]
    longest = np.zeros(len(pairs), dtype=np.int64)
    for part in _batches(hits if least > 0 else order, pairs, BATCH_WORDS):
        longest[part] = runs([pairs[k] for k in part])
    # places are looked for where the score can come from
    cut_to: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for part in _batches(hits, pairs, BATCH_WORDS // 4):
        docs, items = [pairs[k][0] for k in part], [pairs[k][1] for k in part]
        (a, b), (c, d) = spans(docs, items, best[part]), spans(items, docs, best[part])
        for i, k in enumerate(part):
            cut_to[k] = (int(a[i]), docs[i][a[i] : b[i]], items[i][c[i] : d[i]])
    small = {k: (x, y) for k, (_, x, y) in cut_to.items()}
    hits.sort(key=lambda k: (len(small[k][0]) // 8, len(small[k][1])))
    for part in _batches(hits, small, BATCH_WORDS // 4):
        for k, (v, x, y) in zip(part, placed([small[k] for k in part], best[part]), strict=True):
            out[k] = (v, cut_to[k][0] + x, cut_to[k][0] + y, int(longest[k]))
    if least <= 0:
        out = [(0, 0, 0, int(longest[k])) if r is None else r for k, r in enumerate(out)]
    return out


def _batches(order: list[int], pairs, most: int) -> Iterator[list[int]]:
    part: list[int] = []
    words = 0
    for k in order:
        a, b = pairs[k]
        n, m = len(a) >> 3, len(b)
        wide = n if n > m else m
        if wide < words:
            wide = words
        if part and wide * (len(part) + 1) > most:
            yield part
            part, wide = [], max(n, m)
        words = wide
        part.append(k)
    if part:
        yield part


def windows(spans: list[tuple[int, int]], item_words: int) -> list[tuple[int, int]]:
    """The spans, long ones cut into windows that overlap so far that every alignment lies in one whole: it holds m words of
    the item at most, and no more gaps than its matches pay for, 3 m words in all."""
    out = []
    over = 3 * item_words
    size = max(MOST_WINDOW, 2 * over)
    for lo, hi in spans:
        while hi - lo > size:
            out.append((lo, lo + size))
            lo += size - over
        out.append((lo, hi))
    return out


class Items:
    """The items as word ids, with the grams of each and their place."""

    def __init__(self, rows: list[tuple[int, str]], gram: int, window: int):
        self.gram, self.window = gram, window
        self.ids: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in rows:
            w = words(text or "")
            self.items.append((item, np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], dtype=np.int64)))
        self.grams = np.unique(np.concatenate([self.keys(w) for _, w in self.items] or [np.zeros(0, dtype=np.uint64)]))

    def of(self, text: str) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.ids.get, w, repeat(0)), dtype=np.int64, count=len(w))

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and places of the items' grams in the word ids."""
        known = w > 0
        at = np.flatnonzero(known[: len(w) - self.gram + 1]) if len(w) >= self.gram else np.zeros(0, dtype=np.int64)
        for g in range(1, self.gram):
            at = at[known[at + g]]
        k = self.mixed(w, at)
        i = np.searchsorted(self.grams, k)
        found = self.grams[np.minimum(i, len(self.grams) - 1)] == k if len(self.grams) else np.zeros(len(k), dtype=bool)
        return k[found], at[found]

    def mixed(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = np.zeros(len(at), dtype=np.uint64)
        for g in range(self.gram):
            k = (k ^ w[at + g].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        return k | np.uint64(1)

    def keys(self, w: np.ndarray) -> np.ndarray:
        """A 64-bit key for each gram of an item's word ids."""
        return self.mixed(w, np.arange(max(0, len(w) - self.gram + 1)))

    def seeds(self, df: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """key → (index of the item, place): for every window of words its rarest gram (an item shorter than that is
        one window)."""
        out: dict[int, list[tuple[int, int]]] = {}
        for x, (_, w) in enumerate(self.items):
            k = self.keys(w)
            if not len(k):
                continue
            n = np.array([df.get(int(v), 0) for v in k])
            span = min(len(k), max(1, self.window - self.gram + 1))
            chosen = {s + int(np.argmin(n[s : s + span])) for s in range(len(k) - span + 1)}
            for p in sorted(chosen):
                out.setdefault(int(k[p]), []).append((x, p))
        return out


def leaks(documents: DataFrame, items: DataFrame, gram: int = GRAM, window: int = WINDOW, least_score: int = MATCH * 8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, item_words, doc_from, doc_to, longest_run): the best alignment of each document and item
    that share a seed, if it scores at least least_score.

    All documents are read, whole, once for each block of the items: a block is as many items as fit into `block_words` words,
    which is what the driver and a task hold of them, and there may be any number of blocks. Documents with any gram of an
    item are written to the shared folder as word ids with the places of the grams; on these rest the count of documents by
    gram, the choice of seeds and the alignment. No text is shuffled. Null and empty texts hold nothing; repeated rows count
    once; items with several texts are separate; ties go to the first alignment. Extra columns are not read."""
    spark = documents.sparkSession
    known = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // (6 * block_words)))  # a word has about six signs
    docs = documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0")
    found = spark.createDataFrame([], SCHEMA)
    for k in range(blocks):
        rows = sorted((r["item_id"], r["text"]) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        if rows:
            found = found.unionByName(_block(docs, rows, gram, window, least_score))
    # several places of a document, repeats of a row and several texts of an item id give one row, the best
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", F.col("item_words"), (-F.col("doc_from")).alias("f"), "doc_to")).alias("b"), F.max("longest_run").alias("longest_run")
    ).select("doc_id", "item_id", "b.score", "b.item_words", (-F.col("b.f")).alias("doc_from"), "b.doc_to", "longest_run")


SCHEMA = "doc_id bigint, item_id bigint, score int, item_words int, doc_from int, doc_to int, longest_run int"


def _block(docs: DataFrame, rows: list[tuple[int, str]], gram: int, window: int, least_score: int) -> DataFrame:
    """The alignments of the documents with the items of one block."""
    held = Items(rows, gram, window)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                w = held.of(t)
                k, at = held.hits(w)
                if len(k):
                    out.append((doc, w.astype(np.int32).tobytes(), (k >> np.uint64(1)).astype(np.int64), at.astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "w", "k", "at"])

    hits = cut(docs.mapInPandas(look, "doc_id bigint, w binary, k array<bigint>, at array<int>"))
    counts = hits.select(F.explode(F.array_distinct("k")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    seeds = held.seeds({(r["k"] << 1) | 1: r["n"] for r in counts.collect()})  # as bounded as the block: at most one a word
    keys = np.array(sorted(k >> 1 for k in seeds), dtype=np.int64)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            todo: list[tuple[int, int, int]] = []
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            out: list[tuple] = []

            def flush(todo=todo, pairs=pairs, out=out):
                for (doc, x, lo), r in zip(todo, align_all(pairs, least_score), strict=True):
                    if r is not None:
                        out.append((doc, held.items[x][0], r[0], len(held.items[x][1]), lo + r[1], lo + r[2], r[3]))
                todo.clear()
                pairs.clear()

            for doc, raw, k, at in zip(pdf["doc_id"], pdf["w"], pdf["k"], pdf["at"], strict=True):
                k, at = np.asarray(k, dtype=np.int64), np.asarray(at)
                i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                chosen = np.flatnonzero(keys[i] == k)
                if not len(chosen):
                    continue
                w = np.frombuffer(raw, dtype=np.int32)
                spans: dict[int, list[tuple[int, int]]] = {}
                for c in chosen.tolist():
                    p = int(at[c])
                    for x, place in seeds[(int(k[c]) << 1) | 1]:
                        m = len(held.items[x][1])
                        slack = m // 4 + 4
                        lo, hi = max(0, p - place - slack), min(len(w), p - place + m + slack)
                        own = spans.setdefault(x, [])
                        if own and own[-1][0] <= lo <= own[-1][1]:
                            own[-1] = (own[-1][0], max(own[-1][1], hi))
                        else:
                            own.append((lo, hi))
                for x, own in spans.items():
                    for lo, hi in windows(own, len(held.items[x][1])):
                        todo.append((doc, x, lo))
                        pairs.append((w[lo:hi], held.items[x][1]))
                if len(pairs) >= MOST_PAIRS:
                    flush()
            flush()
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "item_words", "doc_from", "doc_to", "longest_run"])

    return hits.mapInPandas(align, SCHEMA)


def _leaks(spark, folder: str, **options) -> DataFrame:
    from sizelake.sources.tables import table

    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), **options)


def p7_found(spark, folder: str) -> DataFrame:
    """Pairs whose alignment holds at least 12 consecutive words of the item; such a run alone scores 12 matches, so that the
    places of alignments that score less need not be looked up."""
    return _leaks(spark, folder, least_score=MATCH * RUN).where(F.col("longest_run") >= RUN).select("doc_id", "item_id")


def p7_leaks(spark, folder: str) -> DataFrame:
    """Every alignment with its score, edited and partial copies included."""
    return _leaks(spark, folder)
