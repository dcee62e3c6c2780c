"""Formulas in cells, the leaves of JSON, labels and headers of tables."""

import pytest
from pyspark.sql import functions as F

from sizelake.functions import cell_formulas as C
from sizelake.functions.json_walk import leaves
from sizelake.functions.rows import column_headers, header_count, row_labels

HOLD = [
    ("= 4*25 = 100", ["us", "vn"]), ("12 * 3 = 40", []), ("1.000 * 2 = 2.000", ["us", "vn"]), ("1,5 * 2 = 3", ["vn"]), ("71.5 / 125 = 57 %", ["us"]), ("(2 + 3) * 4 - 1 = 19", ["us", "vn"]), ("100 / 3 = 33", ["us", "vn"]), ("5 / 0 = 3", []), ("-2 * 3 = -6", ["us", "vn"]),
    ("= (90 + 17.5) * 2410/0.8*1.1 = 356,228 MB/s", ["us"]), ("= 12,406 * 8 = 99,248 KB/s", ["us", "vn"]), ("(4.12 - 3.9)*1,000/28,000 = 1%", ["us"]), ("64,8/18 = 2,311", []), ("2*(3+(4-1)*2)/-3 = -6", ["us", "vn"]), ("7 - -2 = 9", ["us", "vn"]), ("((3)) * 2 = 6", ["us", "vn"]),
    ("2 * = 4", []), ("(2 + 3 = 5", []), ("2 3 + 1 = 6", []), (") * 2 = 1", []), ("08 * 2 = 16", []), ("1 + 2 = 0", []),
]


def _read(spark, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", C.formula(F.col("c")).alias("f"))
    df = df.select("i", "f", C.has_factor(F.col("f"), F.lit(1.1)).alias("has"), C.multiplies(F.col("f")).alias("mul"), C.raises_by_little(F.col("f")).alias("little"))
    return [r for r in df.orderBy("i").collect()]


def test_formula(spark):
    got = _read(spark, [c for c, _ in HOLD])
    assert [(c, r.f and r.f.holds) for (c, _), r in zip(HOLD, got, strict=True)] == HOLD


def test_no_formula(spark):
    cells = ["= 9 = 9", "a * 2 = 4", "", None, "100", "x = y", "= 5", "356,228 MB/s", "__import__('os') = 1", "= -5 = -5"]
    assert [r.f for r in _read(spark, cells)] == [None] * len(cells)


def test_random_arithmetic(spark):
    """The fold against Python's own arithmetic on random expressions."""
    import random

    r = random.Random(5)

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            return str(r.choice([1, 2, 3, 7, 12, 0.5, 2.25]))
        a, b, op = make(depth - 1), make(depth - 1), r.choice("+-*/")
        return r.choice([f"{a} {op} {b}", f"({a} {op} {b})", f"-({a}{op}{b})"])

    texts = [make(4) for _ in range(120)]
    want = []
    for t in texts:
        try:
            want.append(eval(t))  # noqa: S307  texts made above
        except ZeroDivisionError:
            want.append(None)
    got = [x.v for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.arithmetic(F.col("t")).alias("v")).orderBy("i").collect()]
    for t, a, b in zip(texts, got, want, strict=True):
        assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))), (t, a, b)


def test_factor(spark):
    a, b, c, d, e = _read(spark, ["100 * 1.1 = 110", "100 * 2 = 200", "100 + 2 = 102", "3 * 3 = 10", "= 90*2410/0.8*1.1 = 298,238"])
    assert a.has is True and b.has is False and d.has is None and c.mul is False and c.has is False and e.has is True and e.little and not b.little
    assert e.f.terms == [90.0, 2410.0, 0.8, 1.1] and e.f.value == 298238.0 and a.f.unit == "" and e.f.multipliers["us"] == [2410.0, 1.1]


def test_reserve(spark):
    lb = "1. vLB cho truyền hình · thông lượng"
    rows = [
        ("t1", "a", "= (90 + 17.5) * 2410/0.8*1.1 = 356,228 KB/s", lb), ("t1", "b", "= 12,406 * 8 = 99,248 KB/s", lb), ("t1", "c", "356,228 + 99,248 = 455,476 KB/s", lb),
        ("t2", "a", "= 12,406 * 8/0.8*1.2 = 148,872 KB/s", "Tường lửa, lưu lượng"), ("t2", "b", "x", lb), ("t2", "b2", None, lb),
        ("t3", "a", "(612 * 8 * 500) / 1000000 = 2.448", "FW throughput"), ("t3", "b", "2.448 * 1.2 = 2.94", "FW throughput"),
        ("t4", "a", "= 1840*1.1 = 2024 GB", "Máy chủ ứng dụng"), ("t4", "b", "= 100*1.1 = 999", lb), ("t4", "c", "= 100*1.1 = 110", None), ("t4", "d", "= 100*1.1 = 110", "vLB không nói gì thêm"),
        ("t1", "a", "= (90 + 17.5) * 2410/0.8*1.1 = 356,228 KB/s", lb), (None, "a", "1 * 2 = 2", lb),
    ]
    got = {(r.table, r.cell): (r.device, r.state) for r in C.reserve_states(spark.createDataFrame(rows, "table string, cell string, text string, context string").withColumn("device", F.lit("x"))).collect()}
    assert got == {
        ("t1", "a"): ("load balancer", "lacks factor"), ("t1", "b"): ("load balancer", "lacks factor"), ("t1", "c"): ("load balancer", "sum"), ("t2", "a"): ("firewall", "has factor"),
        ("t3", "a"): ("firewall", "intermediate"), ("t3", "b"): ("firewall", "has factor"), ("t4", "a"): (None, "out of scope"), ("t4", "b"): ("load balancer", "no arithmetic"), ("t4", "c"): (None, "out of scope"), ("t4", "d"): ("load balancer", "out of scope"),
    }


def test_leaves():
    got = leaves('{"a": {"b": [1, null, {"c": "x"}]}, "d": true, "e": {}}')
    assert [(x["path"], x["kind"], x["value"]) for x in got] == [("$.a.b[0]", "number", "1"), ("$.a.b[1]", "null", None), ("$.a.b[2].c", "text", "x"), ("$.d", "bool", "true")]
    assert leaves(None) is None and leaves("{") is None and leaves("[]") == [] and len(leaves("[" * 500 + "1" + "]" * 500)) == 1 and leaves("5")[0]["path"] == "$"


TABLES = [
    ([["Tên", "CPU"], ["a", "1"], ["b", "2"]], 1, ["a", "b"], ["Tên", "CPU"]),
    ([["Tên", "Loại", "CPU"], ["Worker", "Tổng", "8"], ["Worker", "Thiết kế", "9"]], 1, ["Worker / Tổng", "Worker / Thiết kế"], ["Tên", "Loại", "CPU"]),
    ([["", "A", "A"], ["", "x", "y"], ["w", "8", "1"]], 2, ["w"], ["", "A / x", "A / y"]),
    ([["a", "b"], ["1", "2"]], 1, ["1"], ["a", "b"]),
    ([["L" * 79, "L" * 79], ["cores", None], ["w", "8", "1"]], 2, ["w"], ["cores", "", ""]),
    ([["L" * 90], ["5"]], 1, ["5"], ["L" * 80]),
    ([["a"]], 1, [], ["a"]),
    ([["k", "n"], ["x"], ["x", "5"], [None, "6"]], 2, ["x", ""], ["k / x", "n"]),
    ([], None, None, None),
    (None, None, None, None),
]


def test_tables(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TABLES)], "i int, rows array<array<string>>")
    got = df.select("i", F.when(F.size("rows") > 0, header_count(F.col("rows"))).alias("n"), row_labels(F.col("rows")).alias("l"), column_headers(F.col("rows")).alias("h")).orderBy("i").collect()
    for r, (t, n, labels, heads) in zip(got, TABLES, strict=True):
        assert (r.n, r.l, r.h) == (n, labels, heads), t
