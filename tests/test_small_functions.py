"""Formats, canonical JSON, scraped tables, differences with nulls, best matches in blocks, checkpoints that are taken away."""

import os

from pyspark.sql import functions as F

from sizelake.functions import json_walk as J
from sizelake.functions import numbers as N
from sizelake.functions import text as X
from sizelake.functions.images import aspect_ratio
from sizelake.operators.matching import best_by_words
from sizelake.session import cut, release


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_four_digits(spark):
    xs = [0.0, 1.0, 12.5, 123.456, 1234.0, 999.96, 9999.4, 9999.6, 12345.0, 1234567.0, 0.5, 0.001234, 0.00012341, 0.000012344, -1234.6, -0.25, 1e15, 100.0, 1e-7]
    assert [r[0] for r in one(spark, [(x,) for x in xs], "x double", N.four_digits(F.col("x")))] == [f"{x:,.4g}" for x in xs]


def test_differences(spark):
    rows = [(2.0, 1.0), (0.0, 0.0), (0.0, 1.0), (None, 1.0), (1.0, None)]
    assert [r[0] for r in one(spark, rows, "a double, b double", N.relative_difference(F.col("a"), F.col("b")))] == [0.5, 0.0, float("inf"), None, None]
    assert [r[0] for r in one(spark, [(4, 2, 1, 1), (None, 2, 3, 1), (0, 0, 3, 0), (None, None, None, None)], "a int, b int, c int, d int", aspect_ratio(*map(F.col, "abcd")))] == [2.0, 3.0, None, None]


def test_canonical(spark):
    a, b, c, d, e = one(spark, [('{"b": [1, {"y": null, "x": 2}], "a": "é"}',), ('{"a":"é","b":[1,{"x":2,"y":null}]}',), ('{"a":"é","b":[{"x":2,"y":null},1]}',), ("{",), (None,)], "s string", J.canonical(F.col("s")), J.canonical_hash(F.col("s")))
    assert a == b and a[0] == '{"a":"é","b":[1,{"x":2,"y":null}]}' and c != a and d == e == (None, None)


def test_html_table(spark):
    page = "<p>x<TABLE border=1><thead class='h'><tr><th>A &amp; B</th><th x='1'>C</th></tr></thead><TBODY><tr><td>1</td><td><b>2</b><br>3</td></tr><tr></tr><tr class=z><td>&lt;4&gt;</td></tr></TBODY></TABLE>"
    got = one(spark, [(page,), ("kein Text",), ("",), (None,)], "s string", X.html_table(F.col("s")))
    assert got[0][0] == [["A & B", "C"], ["1", "2\n3"], ["<4>"]] and got[1:] == [([],), ([],), (None,)]


def test_markdown_cell(spark):
    got = one(spark, [("a|b\n c",), ("x" * 200,), (None,), ("",), ("w " * 99,)], "s string", X.table_cell(F.col("s")))
    assert got[0] == ("a\\|b c",) and got[1] == ("x" * 169 + "…",) and got[2:4] == [(None,), ("",)] and got[4][0].endswith("w…") and len(got[4][0]) <= 170


def test_best_by_words(spark):
    texts = [("sao lưu dữ liệu", 1.0), ("sao luu du lieu", 0.9), ("lưu dữ liệu ngày", 0.8), (None, 1.0), ("", 1.0), ("một", 1.0), ("sao lưu dữ liệu", 1.0)]
    words = F.filter(F.split("text", " "), lambda w: w != "")
    c = spark.createDataFrame(texts, "text string, weight double").withColumn("words", F.array_distinct(words)).withColumn("plain", F.array_distinct(F.transform("words", X.strip_accents)))
    items = [(1, ["sao", "lưu", "dữ", "liệu"]), (2, ["lưu", "dữ", "liệu", "ngày"]), (3, ["khác"]), (4, []), (None, ["sao"]), (5, ["một", "hai"])]
    i = spark.createDataFrame(items, "item bigint, words array<string>").withColumn("head", F.slice("words", 1, 2)).withColumn("plain", F.transform("words", X.strip_accents))
    for block in (20_000, 1):
        got = {r.item: (r.text, r.f1, r.exact) for r in best_by_words(c, i, block).collect()}
        assert got == {1: ("sao lưu dữ liệu", 1.0, True), 2: ("lưu dữ liệu ngày", 1.0, True)}
    only_bare = {r.item: (r.text, r.exact) for r in best_by_words(c.where("text = 'sao luu du lieu'"), i).collect()}
    assert only_bare == {1: ("sao luu du lieu", False), 2: ("sao luu du lieu", False)}
    assert best_by_words(c.limit(0), i).count() == 0 and best_by_words(c, i.limit(0)).count() == 0


def test_release(spark):
    df = cut(spark.range(5))
    folder = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(folder) and df.count() == 5
    release(df)
    assert not os.path.isdir(folder)
    release(spark.range(3))  # no checkpoint: nothing happens
