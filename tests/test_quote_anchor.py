"""Quotes of a document that holds many texts of one pattern: found as SQL finds them, without all pairs."""

from oracle import difference, views

from sizelake.plans import catalog, documents

MANY = 1500
ELEMENT = "doc_id string, element_index int, kind string, text string, page int, section string, section_title string, level int, style string, rows array<array<string>>"


def said(i):
    return f"Đề nghị đơn vị thuyết minh phương án {i} của trung tâm tính cước (phiếu {7 * i})."


def tables(spark, folder):
    e = [("hot", i, "paragraph", said(i)) for i in range(MANY)]
    e += [("hot", MANY + 1, None, "[Trang 3]  " + said(5)), ("hot", MANY + 2, "table", said(6) + " | " + said(7)), ("hot", MANY + 3, "paragraph", "xdungluonglonnhat bangthongtoida\tsolieuthongkex")]
    e += [("hot", MANY + 4, "table", "một hai bangthongtoida bốn năm sáu dungluongluutru"), ("hot", 5, "paragraph", said(5)), ("hot", MANY + 5, "table", "chỉ một bảng nói: sáu bảy tám chín mười mười một mười hai")]
    few = "Hệ số dự phòng của phân hệ lưu trữ là hai mươi phần trăm."
    e += [("few", 3, None, few), ("few", 4, "table", few), ("few", 9, "paragraph", "Theo bảng: " + few.upper())]
    q = [(i, "hot", said(i)) for i in range(MANY)] + [(MANY + i, "hot", said(i)) for i in range(50)]  # one quote under two ids
    q += [(9001, "hot", "dungluonglonnhat bangthongtoida solieuthongke"), (9002, "hot", "hai bangthongtoida bốn năm sáu dungluong"), (9003, "hot", "bảng nói: sáu bảy tám chín mười mười m")]
    q += [(9004, "hot", said(MANY + 8)), (9005, "hot", few), (9006, "few", few), (9006, "hot", said(2)), (9007, None, few), (None, "few", few), (9008, "none", few), (9009, "hot", said(6) + " | Đề nghị đơn vị")]
    spark.createDataFrame([x + (None,) * 6 for x in e], ELEMENT).write.parquet(f"{folder}/elements.parquet")
    spark.createDataFrame(q, "nhan_xet_id long, doc_id string, trich_dan_tai_lieu string").write.parquet(f"{folder}/nhan_xet_dinh_tinh.parquet")


def shuffled(spark, since):
    """(records that stages after `since` wrote for others, the last stage)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    held = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size())]
    return sum(n for s, n in held if s > since), max(s for s, _ in held)


def test_many_texts_of_one_pattern(spark, tmp_path):
    tables(spark, tmp_path)
    _, last = shuffled(spark, -1)
    df = catalog.QUERIES["quote_anchor"](spark, str(tmp_path))
    assert not difference(df, views(str(tmp_path)), catalog.ORACLE["quote_anchor"])
    records, _ = shuffled(spark, last)
    assert records < 100 * MANY  # pairs of texts and quotes that share a word: MANY * MANY


def test_paths_agree(spark, tmp_path, monkeypatch):
    """Compared directly or looked up by runs of words, the same quotes are found."""
    tables(spark, tmp_path)
    for few in (0, 10 * MANY):
        monkeypatch.setattr(documents, "FEW", few)
        assert not difference(catalog.QUERIES["quote_anchor"](spark, str(tmp_path)), views(str(tmp_path)), catalog.ORACLE["quote_anchor"])
