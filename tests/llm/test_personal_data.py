"""Personal data: cases by kind, traps, exact spans in disguised text, edge cases."""

import pytest

from sizelake.llm.personal_data import findings, normalised, personal_data

CASES = [
    ("Kính gửi ông Lý Văn Lãm, bản mới đã xong.", {("name", "Lý Văn Lãm")}),
    ("Nhóm khảo sát gồm Pham Quang Khoanh, Odile Harrow và Trần Ngọc Khuê.", {("name", "Pham Quang Khoanh"), ("name", "Odile Harrow"), ("name", "Trần Ngọc Khuê")}),
    ("Họ tên: ĐỖ GIA KHẮC RUỘNG", {("name", "ĐỖ GIA KHẮC RUỘNG")}),
    ("Prepared by Ada J. Brack-Moss, reviewed by Rufus Quill.", {("name", "Ada J. Brack-Moss"), ("name", "Rufus Quill")}),
    ("Ilsa Vander said the estimate should stay.", {("name", "Ilsa Vander")}),
    ("Mr Tobin Harrow lives at 47/12B Quarry Lane, Delmont.", {("name", "Tobin Harrow"), ("address", "47/12B Quarry Lane, Delmont")}),
    ("Liên hệ ngophien @ vidu.example để lấy số liệu.", {("email", "ngophien @ vidu.example")}),
    ("cc: laml [at] example.com; khue+dc[at]mail[dot]example[dot]com", {("email", "laml [at] example.com"), ("email", "khue+dc[at]mail[dot]example[dot]com")}),
    ("Điện thoại: (+84) 954-941-843", {("phone", "(+84) 954-941-843")}),
    ("Mọi vướng mắc gọi 024 0681 2996 trong giờ hành chính.", {("phone", "024 0681 2996")}),
    ("sđt 0959.420.504 Khối xử lý ảnh chạy tốt.", {("phone", "0959.420.504")}),
    ("gọi 84957997132 hoặc (0951) 866 995", {("phone", "84957997132"), ("phone", "(0951) 866 995")}),
    ("Giấy tờ kèm theo: 0985 5128 1469 (Bùi Hữu Thuẫn).", {("id_number", "0985 5128 1469"), ("name", "Bùi Hữu Thuẫn")}),
    ("Passport Z6047479, phone +84 24 0546 7731", {("id_number", "Z6047479"), ("phone", "+84 24 0546 7731")}),
    ("thường trú tại số 128 ngõ 207 phố Hà Nguyên Thượng - xã Tân Lộ - huyện Đông Lữ - TP. Lam Giang. Kịch bản", {("address", "128 ngõ 207 phố Hà Nguyên Thượng - xã Tân Lộ - huyện Đông Lữ - TP. Lam Giang")}),
    ("Hoá đơn gửi về 367, Tân Khê, Q. Sơn Trà Hạ, Vĩnh Khê.", {("address", "367, Tân Khê, Q. Sơn Trà Hạ, Vĩnh Khê")}),
    ("sdt: không chín năm chín bốn hai không năm không bốn nhé", {("phone", "không chín năm chín bốn hai không năm không bốn")}),
]
TRAPS = [
    "nguồn điện dọc đường Lê Vân Hạ còn yếu", "Công ty Hạ tầng Trần Khê giao đĩa ngày 26/9", "Trung tâm Vận hành Đông Lữ đã nhận hồ sơ", "checksum 950151073201af", "584595574048 khối đã kiểm", "tổng 528562751 byte đã ghi", "mã phiếu 20259872-6260",
    "198.51.100.58 - 200 - 3358 ms", "ảnh bieu-do@2x.png bị mờ", "@tất cả: nộp bản mới", "root@may-ung-dung-68:~# df -h", "mã tài sản TS66390154", "hồ sơ số 514915/BC-DC", "từ 08:30 đến 17:04, 1293 lượt", "HỒ SƠ SAIDRUN TÍNH HAI LẦN VÒNG ĐỜI", "cho đến hết quý ba. HỒ SƠ ZEASA LẤY NHẦM", "bảng định cỡ Breaklim The ingest queue",
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(text, want):
    assert {(k, v) for k, _, _, v in findings(text)} == want


@pytest.mark.parametrize("text", TRAPS)
def test_traps(text):
    assert findings(text) == []


@pytest.mark.parametrize("text, want", CASES[:-1])
def test_disguised(text, want):
    import unicodedata

    for make in (lambda t: unicodedata.normalize("NFD", t), lambda t: "​".join(t), lambda t: t.replace("a", "а").replace("o", "ο"), lambda t: t.replace(" ", " "), lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in t)):
        dirty = make(text)
        got = findings(dirty)
        assert {(k, normalised(v).text) for k, _, _, v in got} == {(k, normalised(v).text) for k, v in want}, dirty
        assert all(dirty[s:e] == v for _, s, e, v in got)


def test_operator(spark):
    rows = [(1, "Ký thay: Vu Thi Hac\n", "a"), (2, None, "b"), (3, "", "c"), (4, "x " * 100_000 + "gọi 0957-773-928", None), (1, "Ký thay: Vu Thi Hac\n", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = [(r.doc_id, r.redacted, r.found) for r in personal_data(df).collect()]
    assert sum(1 for d, t, _ in got if (d, t) == (1, "Ký thay: [NAME]\n")) == 2
    by = {d: (t, f) for d, t, f in got}
    assert by[2] == (None, None) and by[3] == ("", []) and by[4][0].endswith("gọi [PHONE]") and by[4][1][0].start == 200_004
    assert personal_data(df.limit(0)).count() == 0
    clash = personal_data(spark.createDataFrame([("Ký thay: Vu Thi Hac", "b", 3)], "text string, found string, row int")).first()
    assert clash.redacted == "Ký thay: [NAME]" and clash.found[0].value == "Vu Thi Hac" and clash.row == 3
