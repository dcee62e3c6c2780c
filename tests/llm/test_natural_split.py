"""Pieces: limits, overlap, exact round trip, boundaries, edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sizelake.llm.natural_split import cut_text, split_texts

PARTS = st.lists(st.sampled_from(["a", "từ ", "\n", "\n\n", ". ", "; ", ", ", "x" * 40, "é", "🙂", "̂", " | ", "</p>"]), max_size=200).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.sampled_from([(50, 0), (50, 10), (120, 30), (333, 20), (5, 2), (1, 0)]))
def test_round_trip(text, size):
    limit, overlap = size
    got = cut_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in got) == text
    assert all(e - a <= limit and 0 <= b - a <= overlap for a, b, e in got)


def test_natural_boundaries():
    text = " ".join(f"Câu số {i} nói về hệ thống lưu trữ." for i in range(300))
    got = cut_text(text)
    assert len(got) > 4 and all(text[:e].rstrip().endswith(".") for _, _, e in got) and all(150 <= b - a <= 200 for a, b, _ in got[1:])
    sizes = [e - b for _, b, e in got]
    assert max(sizes) < 1.5 * min(sizes)


def test_operator(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 2000, "x"), (4, "b " * 40_000, "x"), (4, "b " * 40_000, "x"), (5, "🙂" * 2001, None)]
    df = spark.createDataFrame(rows, "id int, text string, extra string")
    got = split_texts(df).collect()
    n = {}
    for r in got:
        n[r.id] = n.get(r.id, 0) + 1
        assert len(r.piece_text) <= 2000 and r.new_from - r.start <= 200
    assert 1 not in n and n[2] == n[3] == 1 and n[5] == 2 and n[4] % 2 == 0 and n[4] > 80
    one = sorted((r for r in got if r.id == 5), key=lambda r: r.piece)
    assert one[0].piece_text + one[1].piece_text[one[1].new_from - one[1].start :] == "🙂" * 2001 and one[0].pieces == 2
    assert split_texts(df.limit(0)).count() == 0
    for bad in ({"limit": 10, "overlap": 10},):
        with pytest.raises(ValueError):
            split_texts(df, **bad)
    clash = split_texts(spark.createDataFrame([("a", 7, 8, "z")], "text string, piece int, p int, row string")).first()
    assert (clash.piece, clash.p, clash.row, clash.piece_text) == (0, 8, "z", "a") and split_texts(spark.createDataFrame([("a",)], "text string")).first().pieces == 1
