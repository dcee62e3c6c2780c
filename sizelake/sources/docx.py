"""Word documents as rows, read from the zip and its XML with nothing but the standard library.

    documents(spark, "hdfs://.../folder")    # any file system that Spark reads: bytes come from its own file source
    package_media(spark, "hdfs://.../folder")  # the image files of the packages, and whether anything refers to them
    spark.dataSource.register(DocxSource); spark.read.format("sizelake_docx").load("folder/*.docx")  # files of this machine
"""

from __future__ import annotations

import glob
import io
import os
import posixpath
import re
import string
import urllib.parse
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
SCHEMA = (
    "doc_id string, element_index int, kind string, text string, page int, section string, section_title string, level int, style string, rows array<array<string>>, "
    "image_refs array<struct<rid:string,target:string,alt:string,emu_w:bigint,emu_h:bigint>>, modified string"
)
_COLUMNS = ["doc_id", "element_index", "kind", "text", "page", "section", "section_title", "level", "style", "rows", "image_refs", "modified"]
_HEADING_STYLE = re.compile(r"(?i)^heading\s*(\d)$")
_NUMBERED = re.compile(r"^\s*((?:[IVXLC]+|\d+)(?:\.\d+)*)[.)]?\s+(?=\S)")


# fixed values: Roman numerals by weight
_ROMAN = {1000: "M", 900: "CM", 500: "D", 400: "CD", 100: "C", 90: "XC", 50: "L", 40: "XL", 10: "X", 9: "IX", 5: "V", 4: "IV", 1: "I"}


def _roman(n: int) -> str:
    weight = next((w for w in _ROMAN if w <= n), None)
    return "" if weight is None else _ROMAN[weight] + _roman(n - weight)


def _letters(n: int) -> str:
    """a to z, then aa, ab and on."""
    return "" if n < 1 else _letters((n - 1) // 26) + string.ascii_lowercase[(n - 1) % 26]


_WRITTEN = {"upperRoman": _roman, "lowerRoman": lambda n: _roman(n).lower(), "upperLetter": lambda n: _letters(n).upper(), "lowerLetter": _letters, "none": lambda n: ""}


def number_text(n: int, form: str) -> str:
    """n as the list format writes it; a format without a sign of its own is decimal."""
    return _WRITTEN.get(form, str)(n)


@dataclass(frozen=True)
class Level:
    form: str = "decimal"
    start: int = 1


@dataclass
class Numbering:
    """Automatic lists: their levels, and for each list how far it has counted, outermost level first.

    A list's place is a list of counts as long as the deepest level in use; counting on a level drops what is deeper, as the
    standard has it. Levels that were passed over stand at their start."""

    lists: dict[str, dict[int, Level]] = field(default_factory=dict)
    places: dict[str, list[int | None]] = field(default_factory=dict)

    def label(self, num_id: str, level: int) -> str:
        """The number of the next entry, levels joined by dots; empty for a list or level that is not defined."""
        levels = self.lists.get(num_id, {})
        if level not in levels:
            return ""
        place = (self.places.get(num_id, []) + [None] * (level + 1))[: level + 1]
        place[level] = levels[level].start if place[level] is None else place[level] + 1
        self.places[num_id] = place
        shown = ((levels.get(k, Level()), n) for k, n in enumerate(place))
        return ".".join(filter(None, (number_text(lv.start if n is None else n, lv.form) for lv, n in shown)))


def _xml(z: zipfile.ZipFile, name: str):
    try:
        return ET.fromstring(z.read(name))
    except (KeyError, ET.ParseError):
        return None


def relationships(z: zipfile.ZipFile) -> dict[str, str]:
    """rId → the image's path within the package."""
    root = _xml(z, "word/_rels/document.xml.rels")
    if root is None:
        return {}
    targets = {e.get("Id"): e.get("Target") or "" for e in root if (e.get("Type") or "").endswith("/image")}
    return {k: posixpath.normpath(v.lstrip("/") if v.startswith("/") else posixpath.join("word", v)) for k, v in targets.items()}


def media(z: zipfile.ZipFile) -> dict[str, bytes]:
    """The image files of the package by path, whether or not anything refers to them."""
    return {n: z.read(n) for n in z.namelist() if n.startswith("word/media/") and not n.endswith("/")}


def _val(node, tag: str, otherwise: str | None = None) -> str | None:
    """The value of a child such as <w:start w:val="3"/>."""
    child = node.find(W + tag) if node is not None else None
    return otherwise if child is None else child.get(W + "val", otherwise)


def numbering(z: zipfile.ZipFile) -> Numbering:
    root = _xml(z, "word/numbering.xml")
    if root is None:
        return Numbering()
    drawn = {
        a.get(W + "abstractNumId"): {int(v.get(W + "ilvl", "0")): Level(_val(v, "numFmt", "decimal"), int(_val(v, "start", "1"))) for v in a.iter(W + "lvl")}
        for a in root.iter(W + "abstractNum")
    }
    return Numbering({n.get(W + "numId"): drawn.get(_val(n, "abstractNumId"), {}) for n in root.iter(W + "num")})


def modified(z: zipfile.ZipFile) -> str | None:
    root = _xml(z, "docProps/core.xml")
    if root is None:
        return None
    e = next((x for x in root if x.tag.endswith("}modified")), None)
    return e.text[:19] if e is not None and e.text else None


def _text(node) -> str:
    out = []
    for e in node.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag == W + "br" and e.get(W + "type") != "page":
            out.append("\n")
    return "".join(out)


def _breaks(node) -> int:
    n = sum(1 for _ in node.iter(W + "lastRenderedPageBreak"))
    return n or sum(1 for b in node.iter(W + "br") if b.get(W + "type") == "page")


def _spans(cell) -> tuple[int, bool]:
    """How many columns a cell takes, and whether it goes on from the cell above."""
    pr = cell.find(W + "tcPr")
    wide = _val(pr, "gridSpan", "1")
    merge = pr.find(W + "vMerge") if pr is not None else None
    return max(1, int(wide)) if wide and wide.isdigit() else 1, merge is not None and merge.get(W + "val", "continue") == "continue"


def table_grid(table) -> list[list[str]]:
    """The table as a rectangle: a horizontal span repeats its text, a vertical continuation takes the text above. First the
    cells are laid on (row, column), then the grid is read off."""
    laid: dict[tuple[int, int], str] = {}
    height = width = 0
    for height, tr in enumerate(table.findall(W + "tr"), 1):
        at = 0
        for tc in tr.findall(W + "tc"):
            n, goes_on = _spans(tc)
            own = "\n".join(filter(None, map(_text, tc.iter(W + "p")))).strip()
            text = laid.get((height - 2, at), own) if goes_on else own
            laid.update({(height - 1, c): text for c in range(at, at + n)})
            at += n
        width = max(width, at)
    return [[laid.get((r, c), "") for c in range(width)] for r in range(height)]


def _images(node, rels: dict[str, str]) -> list[dict]:
    out = []
    for d in node.iter(W + "drawing"):
        size, pr = d.find(f".//{WP}extent"), d.find(f".//{WP}docPr")
        for b in d.iter(A + "blip"):
            rid = b.get(R + "embed")
            out.append({"rid": rid, "target": rels.get(rid), "alt": pr.get("descr") if pr is not None else None, "emu_w": int(size.get("cx")) if size is not None else None, "emu_h": int(size.get("cy")) if size is not None else None})
    return out


def section_path(marks: list[str]) -> str:
    """The full number of a heading from the marks above it and its own, outermost first. Word and authors show a part of it
    only; a mark that begins with the mark right above loses that beginning."""
    above = ["", *marks]
    return ".".join(filter(None, (m.removeprefix(a + ".") if a else m for a, m in zip(above, marks, strict=False))))


def read_docx(source, doc_id: str | None = None) -> list[tuple]:
    """The elements of a document (a path or a file of bytes) in order, as tuples of SCHEMA."""
    with zipfile.ZipFile(source) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        rels, lists, when = relationships(z), numbering(z), modified(z)
        styles = _xml(z, "word/styles.xml")
    names = {} if styles is None else {s.get(W + "styleId"): n.get(W + "val") for s in styles.findall(W + "style") if (n := s.find(W + "name")) is not None}
    doc = doc_id or os.path.splitext(os.path.basename(source))[0]
    out: list[tuple] = []
    page, breaks_seen, stack, title, section = 1, False, {}, "", ""
    for node in body if body is not None else ():
        n = _breaks(node)
        breaks_seen |= n > 0
        page += n
        if node.tag == W + "tbl":
            grid = table_grid(node)
            text = "\n".join(" | ".join(c for k, c in enumerate(r) if k == 0 or c != r[k - 1]) for r in grid)
            out.append((doc, len(out), "table", text, page, section, title, None, None, grid, _images(node, rels), when))
            continue
        if node.tag != W + "p":
            continue
        pr = node.find(W + "pPr")
        sid = pr.find(W + "pStyle") if pr is not None else None
        style = names.get(sid.get(W + "val"), sid.get(W + "val")) if sid is not None else None
        text, images = _text(node).strip(), _images(node, rels)
        num = pr.find(W + "numPr") if pr is not None else None
        in_list = _val(num, "numId")
        label = lists.label(in_list, int(_val(num, "ilvl", "0"))) if in_list is not None else ""
        h = _HEADING_STYLE.match(style or "")
        typed = _NUMBERED.match(text)
        level = int(h[1]) if h else None
        if h and text:
            stack = {k: v for k, v in stack.items() if k < level} | {level: label or (typed[1] if typed else "")}
            title, section = text, section_path([stack[k] for k in sorted(stack)])
            out.append((doc, len(out), "heading", text, page, section, title, level, style, None, images, when))
        elif images and not text:
            out.append((doc, len(out), "image", None, page, section, title, None, style, None, images, when))
        elif text:
            out.append((doc, len(out), "paragraph", f"{label}. {text}" if label else text, page, section, title, None, style, None, images, when))
    return out if breaks_seen else [(*r[:4], None, *r[5:]) for r in out]  # without any break pages are unknown


def _files(spark, path: str, glob_filter: str = "*.docx"):
    """(path, content) of the Word files below a folder of any file system; open copies are left out."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob_filter).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return f.where(~F.substring_index("path", "/", -1).startswith("~$") & ~F.substring_index("path", "/", -1).startswith("~%24"))


def _name(path: str) -> str:
    return os.path.splitext(os.path.basename(urllib.parse.unquote(path)))[0]


def documents(spark, path: str):
    """The elements of every Word file below `path`; a file that is no readable package has one row of kind 'unreadable'.
    An empty folder gives no rows."""

    def read(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += read_docx(io.BytesIO(content), _name(p))
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    rows.append((_name(p), 0, "unreadable", type(e).__name__, None, None, None, None, None, None, [], None))
            yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)

    return _files(spark, path).mapInPandas(read, SCHEMA)


def package_media(spark, path: str):
    """(doc_id, path, data, referenced): every image file of every package below `path`, with its bytes, and whether an
    element refers to it. What nothing refers to stands, as a rule, in headers, footers or text boxes."""

    def read(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    used = {i["target"] for r in read_docx(io.BytesIO(content), "x") for i in r[10]}
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(_name(p), n, data, n in used) for n, data in media(z).items()]
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "path", "data", "referenced"], dtype=object)

    return _files(spark, path).mapInPandas(read, "doc_id string, path string, data binary, referenced boolean")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        found = sorted(glob.glob(self.path, recursive=True)) if any(c in self.path for c in "*?[") else [self.path]
        return [_File(p) for p in found if p.lower().endswith(".docx") and not os.path.basename(p).startswith("~$")] or [_File("")]

    def read(self, part):
        if not part.path:
            return
        for r in read_docx(part.path):
            images = [tuple(i[k] for k in ("rid", "target", "alt", "emu_w", "emu_h")) for i in r[10]]
            yield (*r[:10], images, r[11])


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sizelake_docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
