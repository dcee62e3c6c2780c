"""Word documents built in memory, workbooks, Markdown, CSV, JSON, rule books."""

import json
import zipfile

import pytest

from sizelake.sources import files
from sizelake.sources.docx import DocxSource, Level, Numbering, documents, number_text, package_media, read_docx, section_path, table_grid

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'


def p(text, style=None, extra="", num=None):
    pr = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{pr}</w:pPr><w:r>{extra}<w:t>{text}</w:t></w:r></w:p>"


def tc(text, span=None, merge=None):
    pr = (f'<w:gridSpan w:val="{span}"/>' if span else "") + (f'<w:vMerge w:val="{merge}"/>' if merge else "")
    return f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


def docx(path, body, numbering=None):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId5" Type="http://x/image" Target="media/image1.png"/><Relationship Id="rId6" Type="http://x/styles" Target="styles.xml"/></Relationships>')
        z.writestr("docProps/core.xml", '<c xmlns:d="http://purl.org/dc/terms/"><d:modified>2024-05-06T07:08:09Z</d:modified></c>')
        if numbering:
            z.writestr("word/numbering.xml", numbering)


IMAGE = '<w:p><w:r><w:drawing><wp:inline><wp:extent cx="900" cy="600"/><wp:docPr descr="alt"/><a:blip r:embed="rId5"/></wp:inline></w:drawing></w:r></w:p>'


def test_read_docx(tmp_path):
    table = f"<w:tbl><w:tr>{tc('CPU', span=2)}{tc('RAM')}</w:tr><w:tr>{tc('a', merge='restart')}{tc('1')}{tc('2')}</w:tr><w:tr>{tc('', merge='continue')}{tc('3')}</w:tr></w:tbl>"
    body = p("Mở đầu") + p("IV. Mô hình", "Heading1") + p("1. Phân hệ", "Heading2") + table + p("Sau", extra='<w:br w:type="page"/>') + IMAGE + p("") + p("V. Kết luận", "Heading1")
    docx(tmp_path / "a.docx", body)
    e = read_docx(str(tmp_path / "a.docx"))
    assert [(x[2], x[4], x[5]) for x in e] == [("paragraph", 1, ""), ("heading", 1, "IV"), ("heading", 1, "IV.1"), ("table", 1, "IV.1"), ("paragraph", 2, "IV.1"), ("image", 2, "IV.1"), ("heading", 2, "V")]
    assert e[3][9] == [["CPU", "CPU", "RAM"], ["a", "1", "2"], ["a", "3", ""]] and e[3][3].startswith("CPU | RAM\n")
    assert e[5][10] == [{"rid": "rId5", "target": "word/media/image1.png", "alt": "alt", "emu_w": 900, "emu_h": 600}] and e[0][11] == "2024-05-06T07:08:09"


def test_pages_unknown_and_numbering(tmp_path):
    num = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="upperRoman"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    docx(tmp_path / "b.docx", p("Một", "Heading1", num=(3, 0)) + p("Hai", "Heading2", num=(3, 1)) + p("Ba", "Heading2", num=(3, 1)) + p("Bốn", "Heading1", num=(3, 0)) + p("Năm", "Heading2", num=(3, 1)), num)
    e = read_docx(str(tmp_path / "b.docx"))
    assert [x[5] for x in e] == ["I", "I.1", "I.2", "II", "II.1"] and {x[4] for x in e} == {None}
    assert [number_text(n, f) for n, f in ((4, "lowerRoman"), (28, "lowerLetter"), (3, "bullet"))] == ["iv", "ab", "3"]
    assert Numbering().label("9", 1) == "" and table_grid(__import__("xml.etree.ElementTree", fromlist=["x"]).fromstring(f"<w:tbl {NS}/>")) == []


def test_numbering_rules(tmp_path):
    """Start values, levels without a sign, letters, lists that are not defined."""
    n = Numbering({"5": {0: Level("decimal", 3), 1: Level("lowerLetter", 1), 2: Level("none", 1), 3: Level("decimal", 7)}})
    assert [n.label("5", k) for k in (0, 1, 1, 2, 3, 3, 1, 0, 3)] == ["3", "3.a", "3.b", "3.b", "3.b.7", "3.b.8", "3.c", "4", "4.a.7"]
    assert n.label("5", 8) == "" and n.label("6", 0) == "" and [number_text(k, "upperLetter") for k in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"] and number_text(1994, "upperRoman") == "MCMXCIV"
    assert [section_path(x) for x in (["IV", "1", "2"], ["IV", "IV.1", "IV.1.2"], ["", "4", "4.1"], ["II", "", "3"], ["1", "11"])] == ["IV.1.2", "IV.1.2", "4.1", "II.3", "1.11"]
    num = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="4"/><w:numFmt w:val="upperRoman"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    docx(tmp_path / "s.docx", p("Một", "Heading1", num=(3, 0)) + p("Hai", num=(8, 0)) + p("1.2 Ba", "Heading2"), num)
    assert [(x[3], x[5]) for x in read_docx(str(tmp_path / "s.docx"))] == [("Một", "IV"), ("Hai", "IV"), ("1.2 Ba", "IV.1.2")]


def test_any_file_system(spark, tmp_path):
    docx(tmp_path / "d.docx", p("Một") + IMAGE)
    docx(tmp_path / "~$d.docx", p("tạm"))
    with zipfile.ZipFile(tmp_path / "d.docx", "a") as z:
        z.writestr("word/media/image1.png", b"a")
        z.writestr("word/media/image2.png", b"bc")
    (tmp_path / "e.docx").write_bytes(b"no package")
    rows = documents(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.kind) for r in rows) == [("d", "image"), ("d", "paragraph"), ("e", "unreadable")]
    assert sorted((r.doc_id, r.path, bytes(r.data), r.referenced) for r in package_media(spark, str(tmp_path)).collect()) == [("d", "word/media/image1.png", b"a", True), ("d", "word/media/image2.png", b"bc", False)]


def test_data_source(spark, tmp_path):
    docx(tmp_path / "c.docx", p("Xin chào"))
    docx(tmp_path / "~$c.docx", p("tạm"))
    spark.dataSource.register(DocxSource)
    rows = spark.read.format("sizelake_docx").load(str(tmp_path / "*.docx")).collect()
    assert [(r.doc_id, r.text, r.modified) for r in rows] == [("c", "Xin chào", "2024-05-06T07:08:09")]
    assert spark.read.format("sizelake_docx").load(str(tmp_path / "none*.docx")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"a ""b"", c"\n', encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "a.csv")).collect()[0].asDict() == {"id": "1", "text": 'a "b", c'}
    files.write_csv(spark.createDataFrame([("x", 'a"b\nc')], "k string, v string"), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).first().v == 'a"b\nc'
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.json").write_text('{"id": "a", "n": 1}')
    (tmp_path / "j/2.json").write_text('{"id": "b", ')
    good, bad = files.read_json_tolerant(spark, str(tmp_path / "j"), "id string, n int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and bad.count() == 1
    assert files.read_overrides(spark, str(tmp_path / "nope.json")) == ({}, f"{tmp_path}/nope.json is not there") and files.read_overrides(spark, str(tmp_path / "j/2.json"))[1]
    (tmp_path / "o.json").write_text('﻿{"a": 1}', encoding="utf-8")
    assert files.read_overrides(spark, str(tmp_path / "o.json")) == ({"a": 1}, "")
    (tmp_path / "m.md").write_text("# T\n| a | b |\n|---|:-:|\n| 1 | x y |\n## S1\n- một\n### S1a\n* hai\n## S2\n- ba\n")
    assert [r.cells for r in files.read_markdown_tables(spark, str(tmp_path / "m.md")).orderBy("line").collect()] == [["a", "b"], ["1", "x y"]]
    assert [tuple(r)[2:] for r in files.read_markdown_sections(spark, str(tmp_path / "m.md")).orderBy("line").collect()] == [("S1", "", "một"), ("S1", "S1a", "hai"), ("S2", "", "ba")]
    assert files.list_files(spark, str(tmp_path), "*.json", "^2").count() == 2


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Mã</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="B2"><v>5</v></c><c r="AA2" t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>')
    rows = files.read_xlsx(str(tmp_path / "x.xlsx"))
    assert rows[0] == ["Mã", "", "ab"] and rows[1][1] == "5" and rows[1][26] == "z"
    (tmp_path / "bad.xlsx").write_bytes(b"x")
    assert [(r.row, len(r.cells)) for r in files.read_workbooks(spark, str(tmp_path)).orderBy("row").collect()] == [(0, 3), (1, 27)]


def test_rule_book(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"id": "A-1", "scope": "subsystem", "check": " a > 1 ", "inputs": [{"name": "a"}, {"name": "b", "required": False, "default": 2}]}, {"id": "A-2", "formula": "a", "compare_with": "b", "tolerance": 0.02, "enabled": False}]}))
    a, b = files.load_rules(spark, str(tmp_path / "r.json"))
    assert a.check == "a > 1" and a.inputs[1].default == 2 and b.blocked() == "disabled" and b.tolerance == 0.02
    (tmp_path / "r.yaml").write_text("rules: []\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            files.load_rules(spark, str(tmp_path / "r.yaml"))
