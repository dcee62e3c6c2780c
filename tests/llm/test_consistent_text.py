"""Consistent forms: what looks the same is equal, what a reader can tell apart is not; edge cases."""

import pytest

from sizelake.functions.unicode_forms import as_latin, base_form, fold
from sizelake.llm.consistent_text import consistent_text, lookalike_pairs, readings, vocabulary

CLEAN = "Kết quả đo: Điểm CPU của phân hệ Beza-12 là 4.160 kbps"


def forms(spark, texts, words=None):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "i int, text string, word string")
    w = spark.createDataFrame([(x,) for x in words], "word string") if words is not None else None
    return {r.i: r.form for r in consistent_text(df, "text", w).collect()}


def test_disguises(spark):
    import unicodedata

    full = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" if c == " " else c for c in CLEAN)
    variants = [CLEAN, unicodedata.normalize("NFD", CLEAN), full, CLEAN.replace(" ", " "), CLEAN.replace("quả", "q​u­ả﻿"), CLEAN.replace("Đ", "Ð"), CLEAN.replace("Đ", "Ɖ"), CLEAN.replace("e", "е").replace("a", "а").replace("p", "р"), CLEAN.replace("o", "ο").replace("CPU", "СРU"), CLEAN.replace("ả", "ả")]  # noqa: E501
    assert set(forms(spark, variants).values()) == {CLEAN}


@pytest.mark.parametrize("other", [CLEAN.lower(), CLEAN.replace("ế", "ê"), CLEAN.replace("4", "5"), CLEAN.replace("kbps", "kbps²"), CLEAN.replace(" ", "  "), CLEAN + "…", CLEAN.replace("-", "–"), CLEAN.replace("quả ", "")])
def test_visible_differences_stay(spark, other):
    assert len(set(forms(spark, [CLEAN, other]).values())) == 2


def test_scripts(spark):
    russian = "Система хранения данных"
    got = forms(spark, [russian, "Систeма хранeния", "tốc độ ТВ", "β-hội tụ"], ["tốc", "độ", "tb", "система", "хранения", "данных"])
    assert got == {0: russian, 1: "Система хранения", 2: "tốc độ TB", 3: "β-hội tụ"}
    assert readings("Рhаsеn")[0] == "Phasen" and readings("систeма")[0] == "система" and as_latin("ӑ") == "ă" and base_form("ＡＢ　c") == "AB c" and fold("Đặng ТВ") == "dang tb"


def test_other_alphabets(spark):
    """Greek, Armenian, Cherokee, styled letters, ligatures and Roman numerals within words; symbols and real words stay."""
    texts = ["αpple pie", "νice day", "ρaypal login", "χray κit υser", "ոօte it", "ᎪᏴᏟ plan", "𝐒𝐢𝐳𝐢𝐧𝐠 𝟒𝟐", "ﬁle oﬃce", "Mục Ⅳ.2", "hệ số α là 2 và ρ là 3", "λόγος και τέχνη", "m² và ½"]
    want = ["apple pie", "nice day".replace("n", "v", 1), "paypal login", "xray kit user", "note it", "ABC plan", "Sizing 42", "file office", "Mục IV.2", "hệ số α là 2 và ρ là 3", "λόγος και τέχνη", "m² và ½"]
    assert forms(spark, texts) == dict(enumerate(want))


def test_edges(spark):
    got = forms(spark, [None, "", " ", "x" * 200_000, "а" * 1000, CLEAN, CLEAN])
    assert got[0] is None and got[1] == "" and got[2] == " " and len(got[3]) == 200_000 and got[5] == got[6] == CLEAN
    assert consistent_text(spark.createDataFrame([], "text string")).count() == 0
    clash = consistent_text(spark.createDataFrame([("ＡＢ", "x", 1, "y")], "text string, form string, row int, base string")).first()
    assert clash.asDict() == {"text": "ＡＢ", "form": "AB", "row": 1, "base": "y"}
    assert consistent_text(spark.createDataFrame([("ＡＢ",)], "form string"), "form").first().form == "AB"
    words = {r.word for r in vocabulary(spark.createDataFrame([("Số máy Рhа СРU",), (None,)], "text string")).collect()}
    assert words == {"số", "máy"}


def test_pairs(spark):
    rows = [("text", None, "d", 1, "Định cỡ"), ("text", None, "d", 1, "Định cỡ"), ("text", None, "d", 2, "Ðịnh cỡ"), ("text", None, None, 3, "Định cỡ"), ("cau_chua", 7, "d", None, "Định cỡ"), ("cau_chua", 8, "e", None, "Ðịnh cỡ"), ("trich_dan_tai_lieu", 7, "d", None, "Định  cỡ"), ("cau_chua", 9, None, None, "Ðịnh cỡ"), ("cau_chua", 10, "d", None, "")]
    df = spark.createDataFrame(rows, "field string, record_id bigint, doc_id string, element_index int, text string")
    assert {tuple(r) for r in lookalike_pairs(consistent_text(df)).collect()} == {("cau_chua", 7, "d", 2)}
