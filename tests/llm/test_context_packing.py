"""Packing: every token has one place, texts are whole, little room is left."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sizelake.llm.context_packing import TOKENIZER, encoding, pack, places, plan


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_plan(h):
    p = plan(h, (16, 32, 64), 2)
    got = {}
    for times, length, items in p:
        held = sum(s * n for s, n in items)
        assert held <= length and times > 0 and not any(held <= x < length for x in (16, 32, 64))
        for s, n in items:
            got[s] = got.get(s, 0) + n * times
    assert got == h
    w = places(p)
    assert set(w) == set(h)


def test_plan_is_tight():
    r = random.Random(5)
    h = {}
    for _ in range(20_000):
        s = min(2048, 1 + int(r.lognormvariate(5.5, 1.2)))
        h[s] = h.get(s, 0) + 1
    p = plan(h)
    total = sum(s * n for s, n in h.items())
    assert total / sum(times * length for times, length, _ in p) > 0.999
    with pytest.raises(ValueError):
        plan({3000: 1})


def test_pack(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["dung", "lượng", "máy", "chủ", "CPU"]) for _ in range(r.choice([1, 5, 50, 300]))), "x") for i in range(120)] + [(200, None, "x"), (201, "", "x"), (202, "máy " * 5000, "x"), (203, "<|endoftext|>", None), (3, "lặp", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint" if False else "doc_id bigint, text string, length string")
    got = pack(df).collect()
    enc = encoding(TOKENIZER)
    want = {}
    for i, t, _ in rows:
        if t:
            want[i] = want.get(i, 0) + len(enc.encode_ordinary(t))
    have, used = {}, {}
    for x in got:
        have[x.doc_id] = have.get(x.doc_id, 0) + x.n_tokens
        used.setdefault(x.context_id, []).append((x.offset, x.n_tokens, x.length))
    assert have == want
    for items in used.values():
        end = 0
        for o, n, length in sorted(items):
            assert o == end
            end += n
        assert end <= items[0][2] <= 2048 and len({x[2] for x in items}) == 1
    assert {x.doc_id for x in got if x.piece > 0} == {202} and sorted(x.from_token for x in got if x.doc_id == 202)[:2] == [0, 2048]
    assert pack(df.limit(0)).count() == 0
