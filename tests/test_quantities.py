"""Amounts: the grammar's decision table, unit resolution, and the operator's edge cases."""

import pytest

from sizelake.functions.quantity_grammar import UnitTable, bracket, parse_amount, read_number, to_base, unit_behind
from sizelake.operators.quantities import disagreements, normalised_values

UNITS = [
    ("dung_luong", "mbyte", "MB", False, 1048576.0, "byte"), ("dung_luong", "gbyte", "GB", False, 1073741824.0, "byte"), ("dung_luong", "gbyte", "Gb", False, 1073741824.0, "byte"),
    ("bang_thong", "mbps", "Mbps", True, 1e6, "bps"), ("bang_thong", "mbps", "Mb/s", True, 1e6, "bps"), ("bang_thong", "mbyte_s", "MB/s", True, 8e6, "bps"),
    ("thoi_gian", "gio", "giờ", False, 3600.0, "giay"), ("thoi_gian", "phut", "phút", False, 60.0, "giay"), ("giao_dich", "tps", "tps", False, 1.0, "tps"), ("giao_dich", "tpm", "giao dịch/phút", False, 1 / 60, "tps"),
    ("cpu", "vcpu", "vCPU", False, None, "vcpu"), ("cpu", "vcpu", "lõi", False, None, "vcpu"), ("cpu", "cint", "CINT2017", False, None, "cint"), (None, None, None, None, None, None),
]
TABLE = UnitTable(UNITS)


@pytest.mark.parametrize("text, want", [
    ("2.000.000", 2e6), ("7,25", 7.25), ("0.031", 0.031), ("9.876,5", 9876.5), ("9,876.5", 9876.5), ("2.750", 2750), ("2,750", 2.75), ("1 048 576", 1048576), ("0,125", 0.125), ("00.125", 0.125),
    ("1.5", 1.5), ("12.3456", 12.3456), ("1,234,567.8", 1234567.8), ("48", 48), ("1 234,5", 1234.5),
])
def test_numbers(text, want):
    assert read_number(text) == want


@pytest.mark.parametrize("text", ["0–31", "2-6", "", "  ", None, "N/A", "xem phụ lục 7", "không rõ", "theo thiết kế", "０–３１", "abc", "."])
def test_no_single_value(text):
    assert parse_amount(text, TABLE) is None


@pytest.mark.parametrize("raw, amount, dims", [
    ("10 GB", 10 * 2**30, "byte^1"), ("10GiB", 10 * 2**30, "byte^1"), ("8 Mb/s", 8e6, "bit^1;time^-1"), ("8 MB/s", 64e6, "bit^1;time^-1"), ("1 giờ 30 phút", 5400, "time^1"), ("17 gio 42 phut", 63720, "time^1"),
    ("345,41 nghìn giao dịch/giờ", 345410 / 3600, "time^-1;txn^1"), ("2 triệu giao dịch/phút", 2e6 / 60, "time^-1;txn^1"), ("khoảng 5 hours", 18000, "time^1"), ("~7 days", 604800, "time^1"), ("1 152 giờ", 1152 * 3600, "time^1"),
    ("250 CINT2017", 250, "unit:cint^1"), ("4 lõi", 4, "unit:vcpu^1"), ("３ ＧＢ", 3 * 2**30, "byte^1"), ("8.388.608ΜiΒ", 8388608 * 2**20, "byte^1"), ("20 °C", 293.15, "kelvin^1"), ("68 °F", 293.15, "kelvin^1"),
])
def test_amounts(raw, amount, dims):
    got = to_base(raw, None, None, None, TABLE)
    assert got[0] == pytest.approx(amount) and got[1] == dims and got[4] == "own"


MORE = UnitTable([*UNITS, ("nguoi_dung", "user", "user", False, None, "user"), ("dien", "W", "W", True, 1.0, "W"), ("do_dai", "m", "m", True, 1.0, "m"), ("do_dai", "cm", "cm", True, 0.01, "m")])


@pytest.mark.parametrize("raw, amount, dims", [
    ("1.5 GB/user", 1.5 * 2**30, "byte^1;unit:user^-1"), ("5 GB mỗi user", 5 * 2**30, "byte^1;unit:user^-1"), ("3 kW", 3000, "group:dien^1"), ("2 MW·phút", 1.2e8, "group:dien^1;time^1"), ("5 m2", 5, "group:do_dai^2"), ("5 m^2", 5, "group:do_dai^2"), ("5 m²", 5, "group:do_dai^2"),
    ("30000 cm2", 3, "group:do_dai^2"), ("1 GB.s", 2**30, "byte^1;time^1"), ("2,5k user", 2500, "unit:user^1"), ("2,5 k user", 2500, "unit:user^1"), ("1.5e3 GB", 1500 * 2**30, "byte^1"), ("2 x 10^3 user", 2000, "unit:user^1"), ("2×10³ user", 2000, "unit:user^1"), ("4e-3 giờ", 14.4, "time^1"),
    ("5 MB/giây/user", 4e7, "bit^1;time^-1;unit:user^-1"), ("6 foo/bar", 6, "word:bar^-1;word:foo^1"), ("6 foo / bar", 6, "word:bar^-1;word:foo^1"), ("3 xyz^2", 3, "word:xyz^2"), ("10 ms", 0.01, "time^1"), ("100 req/s per node", 100, "time^-1;txn^1;word:node^-1"), ("8 m/s^2", 8, "group:do_dai^1;time^-2"),
])
def test_compound_units(raw, amount, dims):
    got = to_base(raw, None, None, None, MORE)
    assert got[0] == pytest.approx(amount) and got[1] == dims


def test_bounds_are_no_single_value():
    """A bound leaves one side open: it is a range, and ranges are no case."""
    assert all(to_base(x, None, None, None, MORE) is None for x in ("≥ 5 GB", "< 3 giờ", ">= 10 user", "tối đa 5 GB", "5 GB trở lên"))


def test_where_the_unit_comes_from():
    quote = "Định cỡ bộ đệm ghi của phân hệ Leaxai-1501 là 5, mã 11086."
    assert to_base("5", "GB.", quote, "MB", TABLE)[4] == "beside"
    assert to_base("5", None, quote.replace("là 5", "là 5 GB"), "MB", TABLE)[::4] == (5 * 2**30, "quote")
    assert to_base("5", None, quote, "MB", TABLE)[::4] == (5 * 2**20, "rule")
    assert to_base("5", "dự kiến", None, None, TABLE)[4] == "none"
    assert to_base("5 GB", "MB", None, None, TABLE)[4] == "own"
    assert bracket("Bộ đệm (ghi) (Mbyte)") == "Mbyte" and bracket("") is None
    assert unit_behind("28 800", "", "là 28 806 giờ, mã 3", TABLE).base == "giay"  # the number was altered in the quote
    assert to_base("1 giờ 5 GB", None, None, None, TABLE) is None


def frames(spark, values, images):
    v = spark.createDataFrame(values, "value_id bigint, doc_id string, scope_key string, name string, gia_tri_nguyen_van string, cau_chua string, tieu_de_cot string, amount int")
    i = spark.createDataFrame(images, "number_id bigint, doc_id string, scope_key string, name string, gia_tri_raw string, don_vi string, trich_dan string, dims string")
    u = spark.createDataFrame(UNITS, "unit_group string, unit string, alias string, case_sensitive boolean, factor double, base_unit string")
    r = spark.createDataFrame([("R", "luu", "GB"), ("R", "luu", ""), ("R", None, "MB"), (None, "x", None)], "rule_id string, name string, unit string")
    return v, i, u, r


def test_disagreements(spark):
    values = [
        (1, "d", "s", "luu", "10", None, None, 0), (1, "d", "s", "luu", "10", None, None, 0), (2, "d", "s", "luu", "10240 MB", None, None, 0), (3, "d", "s", "luu", "5-6", None, None, 0),
        (4, None, "s", "luu", "1", None, None, 0), (5, "d", None, "luu", "1", None, None, 0), (6, "d", "s", None, "1 GB", None, None, 0), (7, "d", "s", "cpu", "4 lõi", None, None, 0), (None, "e", "s", "luu", None, None, None, None),
        (8, "d", "s", "luu", "x" * 100_000, "y" * 100_000, "", 0),
    ]
    images = [(1, "d", "s", "luu", "10 GB", None, None, ""), (2, "d", "s", "luu", "10,05", " GB. ", "x", ""), (3, "d", "s", "luu", "11", "", "là 11 GB", ""), (4, "d", "s", "cpu", "9", "CINT2017", None, ""), (5, "d", "s", "cpu", "9 vCPU", None, None, ""), (6, None, "s", "luu", "7 GB", None, None, None)]
    got = {(r.value_id, r.number_id) for r in disagreements(*frames(spark, values, images)).collect()}
    assert got == {(1, 3), (2, 3), (7, 5)}


def test_empty(spark):
    v, i, u, r = frames(spark, [], [])
    assert disagreements(v, i, u, r).count() == 0 and normalised_values(v, u.limit(0), r.limit(0)).count() == 0
