"""Leaks against brute force, alignment against a plain one, edge cases."""

import random

import numpy as np

from sizelake.llm.eval_leaks import GAP, MATCH, MISMATCH, align_all, leaks, words

W = [f"tu{i}" for i in range(400)]


def plain(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = run = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if x == y and x else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
            best = max(best, h[i][j])
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and a[i + k]:
                k += 1
            run = max(run, k)
    return best, run


def test_alignment():
    r = random.Random(7)
    pairs = [(np.array([r.randrange(5) for _ in range(r.randrange(0, 30))], dtype=np.int64), np.array([r.randrange(1, 5) for _ in range(r.randrange(1, 20))], dtype=np.int64)) for _ in range(60)]
    for (a, b), (score, start, end, run) in zip(pairs, align_all(pairs), strict=True):
        assert (score, run) == plain(list(a), list(b))
        assert 0 <= start <= end <= len(a) and plain(list(a[start:end]), list(b))[0] == score
    assert align_all([]) == []


def test_against_brute_force(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(W) for _ in range(r.randrange(5, 60))), "x") for i in range(25)] + [(3, "ngắn", ""), (40, None, ""), (41, "", ""), (None, "x y z", "")]
    docs = []
    for d in range(120):
        t = " ".join(r.choice(W) for _ in range(r.randrange(0, 200)))
        if d % 2:
            w = r.choice(items[:25])[1].split()
            n = min(len(w), r.choice([8, 11, 12, 13, 40]))
            s = r.randrange(len(w) - n + 1)
            t += r.choice([" ", "\n> ", ". "]) + r.choice([" ", "\n", ", "]).join(w[s : s + n]).upper() + " " + t[:50]
        docs.append((d, t, "y"))
    docs += [(200, None, ""), (201, "", ""), (202, " ".join(items[0][1].split() * 50), ""), (5, docs[5][1], "")]
    got = {(x.doc_id, x.item_id) for x in leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")).where("longest_run >= 12").collect()}
    grams = {}
    for i, t, _ in items:
        w = words(t or "")
        if i is not None:
            for k in range(len(w) - 11):
                grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t, _ in docs for w in [words(t or "")] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert got == want and len(want) > 10


def test_forms_and_edits(spark):
    item = "Hồ sơ Briphean nên tách riêng mức nén Hudo tuy nhiên đơn vị Drousaik không dẫn nguồn cho vòng đời dữ liệu Phurox 89"
    edited = item.replace("nguồn", "gốc").replace("đơn vị ", "")
    docs = [(1, "x " + item.upper().replace(" ", " ")), (2, "Hо sо " + item[6:].replace("a", "а")), (3, edited), (4, "không liên quan")]
    got = {x.doc_id: x for x in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[1].longest_run == got[1].item_words == got[2].longest_run and got[3].longest_run < got[3].item_words and got[1].doc_from == 1
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), empty).count() == 0
    assert leaks(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(9, item)], "item_id bigint, text string")).count() == 0


def test_short_and_edited_copies(spark):
    """Exact passages of 8 and 9 words at every place, and copies with every seventh to ninth word edited from any start on."""
    item = W[:60]
    docs, filler = [], [f"la{i}" for i in range(40)]
    for n in (7, 8, 9):  # seven words alone score too little, but copies edited every seventh word do not
        docs += [" ".join(filler[:20] + item[s : s + n] + filler[20:]) for s in range(len(item) - n + 1)] if n > 7 else []
        docs += [" ".join("sua" if i % n == first else x for i, x in enumerate(item)) for first in range(n)]
    common = [" ".join(filler[:3] + item[s : s + 4] + filler[3:6]) for s in range(0, 57, 3)] * 2  # some grams are rarer than others
    rows = [(i, x) for i, x in enumerate(docs + common)]
    got = {x.doc_id for x in leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()}
    assert got == set(range(len(docs)))


def test_windows_hold_every_alignment():
    from sizelake.llm import eval_leaks as E

    r = random.Random(11)
    item = np.array([r.randrange(1, 9) for _ in range(20)], dtype=np.int64)
    doc = np.array([r.randrange(0, 30) for _ in range(30_000)], dtype=np.int64)
    for at in (0, 4_090, 8_150, 12_281, 29_980):
        doc[at : at + 20] = item
    cuts = E.windows([(0, len(doc))], len(item))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(doc) and all(b - a <= E.MOST_WINDOW for a, b in cuts) and all(c - b <= -60 for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False))
    whole = {(x + y, x + z) for (x, _), (s, y, z, _) in zip(cuts, align_all([(doc[a:b], item) for a, b in cuts]), strict=True) if s == 40}
    assert {(0, 20), (29_980, 30_000)} <= whole and len(whole) >= 3


def test_blocks_of_items(spark):
    """Any number of items: with a small block the same rows come out in several passes."""
    r = random.Random(12)
    items = [(i, " ".join(r.choice(W) for _ in range(30))) for i in range(12)]
    docs = [(d, " ".join(r.choice(W) for _ in range(40)) + " " + items[d % 12][1]) for d in range(24)]
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (sorted(map(tuple, leaks(*args, block_words=n).collect())) for n in (2_000_000, 60))
    assert one == many and len(one) >= 24


def test_recall_of_edited_copies(spark):
    """Copies of the held-out items with a share of their words changed, dropped or added, whole and in part: of those that an
    alignment accepts, how many the seeds reach. Figures stand in the README."""
    from sizelake.sources.tables import table

    r = random.Random(13)
    items = [(x.item_id, x.text) for x in table(spark, "/root/testdata/sf0.001", "eval_items").collect()]
    docs, about = [], {}
    for share in (0.05, 0.1, 0.15, 0.2, 0.25, 0.3):
        for part in ("whole", "half"):
            for i, t in items:
                w = t.split()
                w = w if part == "whole" else w[(s := r.randrange(len(w) // 2)) : s + max(12, len(w) // 2)]
                out = []
                for x in w:
                    k = r.random()
                    out += [x] if k > share else [f"khac{r.randrange(999)}"] if k < share / 3 else [] if k < 2 * share / 3 else [x, f"them{r.randrange(999)}"]
                d = len(docs)
                docs.append((d, " ".join([f"la{r.randrange(5000)}" for _ in range(40)] + out + [f"la{r.randrange(5000)}" for _ in range(40)])))
                about[d] = (share, part, i)
    text = dict(items)
    ids: dict = {}
    coded = lambda t: np.array([ids.setdefault(x, len(ids) + 1) for x in words(t)], dtype=np.int64)
    accepted = [d for (d, t), s in zip(docs, align_all([(coded(t), coded(text[about[d][2]])) for d, t in docs]), strict=True) if s[0] >= 16]
    got = {(x.doc_id, x.item_id) for x in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    seen: dict = {}
    for d in accepted:
        share, part, i = about[d]
        n = seen.setdefault((share, part), [0, 0])
        n[0] += 1
        n[1] += (d, i) in got
    rates = {k: round(b / a, 3) for k, (a, b) in seen.items()}
    print("recall by share of edits and part:", rates)
    assert all(v >= 0.9 for v in rates.values()) and all(v >= 0.98 for (share, part), v in rates.items() if part == "whole"), rates
