"""Review sheets: the lines of a reviewer's remarks as labels, each with its kind, what it points at and what it stands under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizelake.functions.text import BLANKS
from sizelake.operators.running import running

# fixed values: what only points at a place, what asks for something, pages, sections, rounds
POINTS = (
    r"^[(\s-]*[Tt]rang\s*\d+(\s*[,;]\s*\d+)*\s*[):.]*$", r"(?iu)^(nhận xét chung|nhận xét)\s*:?\s*$",
    r"(?iu)^(thông tin (hệ thống|đầu vào|thiết kế)( chi tiết| test)?|đề xuất tài nguyên|giải pháp thiết kế|yêu cầu bài toán|định cỡ (hệ thống|thiết bị máy chủ))\s*[:.]?$",
)
HEADS = r"^[Mm]ục\s*[:.]|^[Mm]ục\s+([IVX]+(\.\d+)*|\d+(\.\d+)+)\s*[:.]?\s*.{0,80}$|^[Mm]ục\s+\S.{0,60}$|^[IVX]+\s*\.\s+\S|^\d+(\.\d+)+\s+[A-ZÀ-Ỹ].{0,70}$"
ASKS = r"(^|[^\p{L}])(bổ sung|sửa|làm rõ|lập|bỏ|cập nhật|giải thích|xem lại|không có|chưa có|không đúng|sai|tại sao|kiểm tra|đánh giá|áp dụng|trình bày|tính lại|tính toán lại)($|[^\p{L}])"
PAGES = r"[Tt]rang\s*(\d+(?:\s*,\s*\d+)*)"
SECTIONS = r"[Mm]ục\s+([IVX]+(?:\.\d+)*|\d+(?:\.\d+)+)"
ROUND = r"(?iu)nh[ậa]n\s*x[ée]t\s*l[ầa]n\s*(\d+)"


def atom_kind(text: Column) -> Column:
    """anchor, lead or request. A heading is an anchor only if it asks for nothing; an opener ends with a colon."""
    bare = F.lit(False)
    for p in POINTS:
        bare = bare | text.rlike(p)
    head = text.rlike(HEADS) & ~F.lower(text).rlike(ASKS) & ~text.contains("?")
    return F.when(bare | head, "anchor").when(text.endswith(":"), "lead").otherwise("request")


def pages(text: Column) -> Column:
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PAGES), 1), lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), 1)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def sections(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SECTIONS), 1)


def review_labels(lines: DataFrame, sheet: str, order: str, text: str) -> DataFrame:
    """lines with item (its number, else its place), kind, text, pages, sections and, for requests, lead: the nearest opener
    above, which a pointer to another place ends. Blank and null lines are left out; a sheet may have any number of lines;
    (sheet, order) should be unique."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), f"^{BLANKS}", ""), f"{BLANKS}$", "")
    x = lines.withColumn("__line", clean).where("__line <> ''")
    no = F.regexp_extract("__line", rf"^(\d+)[.)]{BLANKS}", 1)
    x = x.withColumns({"item": F.when(no == "", (F.col(order) + 1).cast("string")).otherwise(no), "__text": F.regexp_replace("__line", rf"^\d+[.)]{BLANKS}", "")})
    x = x.withColumns({"kind": atom_kind(F.col("__text")), "pages": pages(F.col("__text")), "sections": sections(F.col("__text"))})
    mark = F.when(F.col("kind") == "lead", F.col("__text")).when(F.col("kind") == "anchor", "")
    r = running(x, sheet, [order], lasts={"lead": mark}, inclusive=False)
    return r.withColumn("lead", F.when(F.col("kind") == "request", F.nullif(F.col("lead"), F.lit("")))).withColumn(text, F.col("__text")).drop("__line", "__text")


def review_sheets(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(info, labels) of review sheets read as elements (doc_id, element_index, kind, text, rows): info (doc_id, key, value)
    from tables that name the ticket, labels (doc_id, round, element_index, item, atom, ...) from tables of remarks, one for
    each paragraph of a remark, under the round that the nearest line above announces."""
    e = running(elements, "doc_id", ["element_index"], lasts={"round": F.when(F.col("kind") != "table", F.nullif(F.regexp_extract("text", ROUND, 1), F.lit("")).cast("int"))})
    tables = e.where("kind = 'table' and size(rows) > 0").withColumn("head", F.lower(F.array_join(F.get("rows", F.lit(0)), " ")))
    info = tables.where(F.col("head").contains("mã pyc")).select("doc_id", F.explode("rows").alias("r")).where("size(r) >= 2").select("doc_id", F.trim(F.get("r", F.lit(0))).alias("key"), F.trim(F.get("r", F.lit(1))).alias("value")).where("key <> ''")
    remarks = tables.where(F.col("head").contains("nhận xét") & (F.col("head").contains("stt") | F.col("head").contains("phản hồi")) & ~F.col("head").contains("mã pyc"))
    rows = remarks.select("doc_id", "element_index", "round", F.posexplode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).alias("row", "r")).where("size(r) >= 2")
    atoms = rows.select("doc_id", "element_index", "round", "row", F.trim(F.get("r", F.lit(0))).alias("own_no"), F.get("r", F.lit(2)).alias("response"), F.posexplode(F.split(F.get("r", F.lit(1)), "\n")).alias("atom", "text"))
    atoms = atoms.withColumn("place", F.col("element_index").cast("bigint") * 1_000_000_000 + F.col("row") * 10_000 + F.col("atom"))
    labels = review_labels(atoms, "doc_id", "place", "text").withColumn("item", F.when(F.col("own_no") != "", F.col("own_no")).otherwise((F.col("row") + 1).cast("string")))
    return info, labels.drop("own_no", "place")
