"""Scalar functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from sizelake.functions import images as I
from sizelake.functions import numbers as N
from sizelake.functions import text as X


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


@pytest.mark.parametrize("text, style, value, ambiguous, alt", [
    ("2.000.000", "vi", 2e6, False, None), ("7,25", "vi", 7.25, False, None), ("0.031", "vi", 0.031, False, None), ("9.876,5", "vi", 9876.5, False, None), ("9,876.5", "vi", 9876.5, False, None), ("-8,5", "vi", -8.5, False, None),
    ("2.750", "vi", 2750, True, 2.75), ("2,750", "vi", 2.75, True, 2750), ("2.750", "en", 2.75, True, 2750), ("2,750", "en", 2750, True, 2.75), ("1.23.456", "vi", 123456, True, None), ("48 GB", "vi", 48, False, None),
])
def test_parse_number(spark, text, style, value, ambiguous, alt):
    r = one(spark, N.parse_number(F.lit(text), style))
    assert (r["value"], r["ambiguous"], r["alt_value"]) == (value, ambiguous, alt)


def test_number_edges(spark):
    assert one(spark, N.parse_number(F.lit("abc"))) is None and one(spark, N.parse_number(F.lit(None).cast("string"))) is None and one(spark, N.parse_number(F.lit("1,234.5.6"))) is None
    assert [one(spark, N.looks_like_value(F.lit(x))) for x in ("48", "210G", "77%", "-3", "LTO-8", "0-15", "2–6", "", "có khoảng 12 máy chủ cho hệ thống này")] == [True] * 5 + [False] * 4
    assert one(spark, N.looks_like_value(F.lit("0-15"), ranges=False)) and one(spark, N.all_numbers(F.lit("12 và 3,5"))) == [12.0, 3.5]
    assert one(spark, N.parse_percent(F.lit("75%"))) == 0.75 and one(spark, N.half_unit(F.lit("36.25"))) == pytest.approx(0.005) and one(spark, N.whole_or_two(F.lit(2.0))) == "2"
    assert one(spark, N.relative_difference(F.lit(0.0), F.lit(0.0))) == 0 and one(spark, N.suffix_factor(F.lit("Gi"))) == 2.0**30 and one(spark, N.rewrite_convention(F.lit("1.234,5"), "vn")) == "1234.5"
    assert [one(spark, N.is_number_cell(F.lit(x))) for x in ("12 GB", "8", "", "CPU", "3,5 %", "có 3 máy chủ ở đây")] == [True, True, False, False, True, False]


def test_text(spark):
    assert one(spark, X.norm(F.lit("  [Bảng 1]  Số   LƯỢNG "))) == "số lượng" and one(spark, X.strip_accents(F.lit("Đường Ổ đĩa"))) == "Duong O dia" and one(spark, X.fold_key(F.lit("A-b 1."))) == "ab1"
    assert one(spark, X.cut_at_word(F.lit("một hai ba bốn"), 8)) == "một hai…" and one(spark, X.cut_at_word(F.lit("x" * 9), 8)) == "x" * 8 + "…" and one(spark, X.outer_json(F.lit('```{"a": {}}``` x'))) == '{"a": {}}'
    assert one(spark, X.html_to_text(F.lit("<p>a&nbsp;b</p><br/>c &amp;lt;"))) == "a b\n\nc &lt;" and one(spark, X.is_caption(F.lit("Hình 3: Mô hình"))) and not one(spark, X.is_caption(F.lit("Theo hình 3")))
    assert one(spark, X.heading_number(F.lit("IV.1.2 Mô hình"))) == ("IV.1.2", 3) and one(spark, X.heading_number(F.lit("Mô hình"))) is None and one(spark, X.file_family(F.lit("20240102_Sizing_ABC_v2_final.docx"))) == "sizing abc"
    assert [one(spark, X.bijective_letters(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["a", "z", "aa", "zz", "aaa"] and one(spark, X.roman(F.lit(49))) == "XLIX"
    assert one(spark, X.cited_numbers(F.lit("Trang 3, trang 12 và trang 3"), "trang")) == [3, 12] and one(spark, X.section_root(F.lit("iv.2.1"))) == "IV" and one(spark, X.group_code(F.lit("KPI-02"))) == "KPI"
    assert one(spark, X.token_f1(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == pytest.approx(2 / 3) and one(spark, X.is_email(F.lit("a@b.c"))) and one(spark, X.tokens(F.lit("Số lượng, số máy"), ("máy",))) == ["số", "lượng"]


def png(w, h, rgb):
    import struct
    import zlib

    def chunk(k, b):
        return struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))

    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark):
    data = png(5, 3, (10, 10, 10))
    df = spark.createDataFrame([(data,), (b"BM" + b"\x00" * 16 + b"\x07\x00\x00\x00\x09\x00\x00\x00",), (b"junk" * 5,), (None,)], "b binary")
    got = df.select(I.image_format(F.col("b")).alias("f"), I.image_stats("b").alias("s")).select("f", "s.*").collect()
    assert (got[0].f, got[0].width, got[0].height, got[0].colours, got[0].dark) == ("png", 5, 3, 1, 1.0) and (got[1].f, got[1].width, got[1].height) == ("bmp", 7, 9) and got[2].f == "unknown" and got[3].width is None
    assert I.header_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x30" + b"\x00" * 12) == (48, 32)
