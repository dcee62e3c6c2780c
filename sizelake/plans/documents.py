"""Queries over document elements: sections, pages, tables, headings, captions, quotes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sizelake.functions import numbers as N
from sizelake.functions import rows as R
from sizelake.functions import text as X
from sizelake.operators.running import neighbours, running
from sizelake.plans.registry import query
from sizelake.session import cut
from sizelake.sources.tables import table as t

#: Blanks of any kind, for SQL.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

E = "e AS (SELECT DISTINCT doc_id, element_index, kind, text, page, section, section_title, level, style, rows FROM elements WHERE doc_id IS NOT NULL AND element_index IS NOT NULL)"


COLUMNS = ("kind", "text", "page", "section", "section_title", "level", "style", "rows")


def elements(spark, d, *columns):
    """Each element once, with the columns named (all but the time of loading if none is): repeats of a row are equal in all
    of them. As all columns are keys, filters behind it reach the scan, and what is not named is neither read nor shuffled."""
    return t(spark, d, "elements").where("doc_id is not null and element_index is not null").select("doc_id", "element_index", *(columns or COLUMNS)).distinct()


@query("FLT-1 AGG-26 AGG-37", f"""
WITH {E} SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(max(page) AS INT) AS last_page, round(avg(CASE WHEN page IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_page,
 CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM e GROUP BY 1""")
def elements_by_kind(spark, d):
    return elements(spark, d, "kind", "page").groupBy("kind").agg(
        F.count("*").alias("n"), F.max("page").alias("last_page"), F.round(F.avg(F.when(F.col("page").isNotNull(), 1.0).otherwise(0.0)), 6).alias("with_page"),
        F.countDistinct("doc_id").alias("docs"))


@query("FLT-2 FUN-S20", f"""
WITH {E} SELECT doc_id, upper(trim(split_part(coalesce(section, ''), '.', 1))) AS root, CAST(count(*) AS BIGINT) AS n
FROM e WHERE section = '1' OR starts_with(section, '1.') GROUP BY 1, 2""")
def section_subtree(spark, d):
    s = F.col("section")
    return elements(spark, d, "section").where((s == "1") | s.startswith("1.")).groupBy("doc_id", X.section_root(s).alias("root")).agg(F.count("*").alias("n"))


LOCATION = "concat_ws(', ', CASE WHEN section <> '' THEN 'Mục ' || section END, CASE WHEN page IS NOT NULL THEN 'trang ' || page END)"


def location():
    return F.concat_ws(", ", F.when(F.col("section") != "", F.concat(F.lit("Mục "), "section")), F.when(F.col("page").isNotNull(), F.concat(F.lit("trang "), F.col("page").cast("string"))))


@query("PRJ-1", f"""
WITH {E} SELECT doc_id, element_index, CASE WHEN {LOCATION} = '' THEN 'phần tử #' || element_index ELSE {LOCATION} END AS location FROM e""")
def element_location(spark, d):
    """Where each element stands: section and page, its number where both are missing."""
    e = elements(spark, d, "section", "page")
    return e.select("doc_id", "element_index", F.when(location() == "", F.concat(F.lit("phần tử #"), F.col("element_index").cast("string"))).otherwise(location()).alias("location"))


@query("FLT-3", f"WITH {E} SELECT doc_id, element_index, kind FROM e WHERE element_index >= 10 AND element_index < 20")
def element_range(spark, d):
    """The elements of a half-open range; the bounds reach the scan."""
    return elements(spark, d, "kind").where((F.col("element_index") >= 10) & (F.col("element_index") < 20))


def cells_of(e):
    """(doc_id, element_index, r, c, width, height, text): tables as rectangles, short rows padded."""
    e = e.where("kind = 'table' and size(rows) > 0").withColumn("width", F.array_max(F.transform("rows", F.size)))
    r = e.select("doc_id", "element_index", "width", F.size("rows").alias("height"), F.posexplode("rows").alias("r", "row"))
    padded = F.concat("row", F.array_repeat(F.lit(""), F.col("width") - F.size("row")))
    return r.select("doc_id", "element_index", "r", "width", "height", F.posexplode(padded).alias("c", "text"))


CELLS = f"""{E}, tb AS (SELECT doc_id, element_index, rows, list_max(list_transform(rows, lambda x: len(x))) AS width, len(rows) AS height FROM e WHERE kind = 'table' AND len(rows) > 0),
 cells AS (SELECT doc_id, element_index, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(width AS INT) AS width, CAST(height AS INT) AS height,
   CASE WHEN c < len(rows[r + 1]) THEN rows[r + 1][c + 1] ELSE '' END AS text FROM (SELECT *, unnest(range(width)) AS c FROM (SELECT *, unnest(range(height)) AS r FROM tb)))"""
IS_NUM = "(trim(coalesce(text, '')) <> '' AND regexp_matches(text, '[0-9]') AND regexp_full_match(trim(coalesce(text, '')), '[\\s0-9.,]{1,12}[%A-Za-zÀ-ỹ/()\\s]{0,10}'))"


@query("SRC-1 FUN-A2 FLT-8", f"""
WITH {CELLS} SELECT doc_id, element_index, r, c, text, {IS_NUM} AS is_number FROM cells""")
def table_cells(spark, d):
    """Every cell of every table, with whether it holds a number."""
    return cells_of(elements(spark, d, "kind", "rows")).select("doc_id", "element_index", "r", "c", "text", N.is_number_cell(F.col("text")).alias("is_number"))


HEAD = f"""{CELLS}, num AS (SELECT *, {IS_NUM} AS is_num FROM cells),
 head AS (SELECT doc_id, element_index, max(height) AS height, greatest(1, least(coalesce(min(r) FILTER (WHERE is_num AND r < 3), least(3, max(height))), max(height) - 1)) AS n_head FROM num GROUP BY 1, 2)"""


def headed(e):
    """cells with is_num and n_head: the leading rows without a number, three at most, one at least, never all."""
    c = cells_of(e).withColumn("is_num", N.is_number_cell(F.col("text")))
    h = c.groupBy("doc_id", "element_index").agg(F.min(F.when(F.col("is_num") & (F.col("r") < 3), F.col("r"))).alias("first"), F.first("height").alias("h"))
    h = h.select("doc_id", "element_index", F.greatest(F.lit(1), F.least(F.coalesce("first", F.least(F.lit(3), "h")), F.col("h") - 1)).alias("n_head"))
    return c.join(h, ["doc_id", "element_index"])


@query("WIN-10", f"WITH {HEAD} SELECT doc_id, element_index, CAST(n_head AS INT) AS n_head FROM head")
def header_rows(spark, d):
    return headed(elements(spark, d, "kind", "rows")).select("doc_id", "element_index", "n_head").distinct()


# the texts of the header rows of a column with the uppermost k left out, repeats said once; k is the least number that keeps
# every header of the table within 80 signs
HEADERS = f"""{HEAD}, tier AS (SELECT n.doc_id, n.element_index, n.c, k.k, h.n_head, array_to_string(list_filter(list(trim(coalesce(n.text, '')) ORDER BY n.r), lambda x: x <> ''), chr(31)) AS l
   FROM num n JOIN head h USING (doc_id, element_index) JOIN (VALUES (0), (1), (2)) k(k) ON k.k < h.n_head AND n.r >= k.k AND n.r < h.n_head GROUP BY ALL),
 said AS (SELECT doc_id, element_index, c, k, n_head, array_to_string(list_filter(string_split(l, chr(31)), lambda x, i: list_position(string_split(l, chr(31)), x) = i), ' / ') AS header FROM tier),
 fit AS (SELECT doc_id, element_index, coalesce(min(k) FILTER (WHERE longest <= 80), max(k)) AS k FROM (SELECT doc_id, element_index, k, max(length(header)) AS longest FROM said GROUP BY 1, 2, 3) GROUP BY 1, 2),
 headers AS (SELECT doc_id, element_index, c, trim(left(header, 80)) AS header FROM said JOIN fit USING (doc_id, element_index, k))"""


def headers_of(e):
    """(doc_id, element_index, c, header) of tables: headers of several rows joined, see rows.column_headers."""
    return e.where("kind = 'table' and size(rows) > 0").select("doc_id", "element_index", F.posexplode(R.column_headers(F.col("rows"))).alias("c", "header"))


@query("FUN-A3 FUN-A5", f"WITH {HEADERS} SELECT doc_id, element_index, c, header FROM headers")
def column_headers(spark, d):
    return headers_of(elements(spark, d, "kind", "rows"))


SERIAL = r"(?i)^\\s*(stt|tt|s[ốo]\\s*(tt|th[ứu]\\s*t[ựu])|#|no\\.?|num(ber)?|index)\\s*\\.?\\s*$"


@query("FLT-7 FUN-A4 AGG-23", f"""
WITH {HEADERS}, col AS (SELECT n.doc_id, n.element_index, n.c, bool_and(n.is_num) AS numeric FROM num n JOIN head h USING (doc_id, element_index) WHERE n.r >= h.n_head AND trim(n.text) <> '' GROUP BY 1, 2, 3),
 ok AS (SELECT doc_id, element_index, c, header, count(*) OVER (PARTITION BY doc_id, element_index, header) AS k FROM col JOIN headers USING (doc_id, element_index, c) WHERE numeric AND header <> '' AND NOT regexp_matches(header, '{SERIAL}'))
SELECT doc_id, element_index, c, header FROM ok WHERE k = 1""")
def data_columns(spark, d):
    """Columns that hold numbers and nothing else, with their headers. Serial numbers are left out, and so are all columns of
    one name: nothing says which of them is meant."""
    e = elements(spark, d, "kind", "rows")
    c = headed(e).where("r >= n_head and trim(text) <> ''").groupBy("doc_id", "element_index", "c").agg(F.bool_and("is_num").alias("numeric")).where("numeric").drop("numeric")
    ok = c.join(headers_of(e), ["doc_id", "element_index", "c"]).where((F.col("header") != "") & ~F.col("header").rlike(SERIAL))
    return ok.groupBy("doc_id", "element_index", "header").agg(F.min("c").alias("c"), F.count("*").alias("n")).where("n = 1").select("doc_id", "element_index", "c", "header")


@query("FLT-12 FUN-A1", f"""
WITH {E} SELECT doc_id, element_index, list_transform(rows, lambda r: array_to_string(list_filter(r, lambda x, i: i = 1 OR x <> r[i - 1]), ' | ')) AS lines FROM e WHERE kind = 'table'""")
def compact_runs(spark, d):
    """Rows as lines, equal neighbouring cells said once."""
    line = lambda r: F.array_join(F.filter(r, lambda x, i: (i == 0) | (x != F.get(r, i - 1))), " | ")
    return elements(spark, d, "kind", "rows").where("kind = 'table'").select("doc_id", "element_index", F.transform("rows", line).alias("lines"))


@query("WIN-1", f"""
WITH {E} SELECT doc_id, element_index, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY element_index ROWS UNBOUNDED PRECEDING) AS heading
FROM e""")
def carry_forward_marker(spark, d):
    """The heading that each element stands under."""
    mark = F.when(F.col("kind") == "heading", F.col("text")).alias("mark")  # other texts are neither shuffled nor sorted
    return running(elements(spark, d, mark), "doc_id", ["element_index"], lasts={"heading": F.col("mark")}).select("doc_id", "element_index", "heading")


@query("WIN-2 WIN-6", f"""
WITH {E} SELECT doc_id, element_index, CAST(1 + sum(CASE WHEN kind = 'heading' AND level = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS page,
  CAST(sum(CASE WHEN kind = 'image' THEN 1 ELSE 0 END) OVER w AS BIGINT) > 0 AS image_seen FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY element_index ROWS UNBOUNDED PRECEDING)""")
def running_counter(spark, d):
    """A counter that a break raises before it is given to the break itself, and whether an image has come yet."""
    e = elements(spark, d, "kind", "level")
    r = running(e, "doc_id", ["element_index"], sums={
        "breaks": F.when((F.col("kind") == "heading") & (F.col("level") == 1), 1).otherwise(0), "images": F.when(F.col("kind") == "image", 1).otherwise(0)})
    return r.select("doc_id", "element_index", (F.col("breaks") + 1).alias("page"), (F.col("images") > 0).alias("image_seen"))


@query("WIN-4 WIN-5", f"""
WITH {E}, h AS (SELECT doc_id, element_index, level, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS n1, sum(CASE WHEN level <= 1 THEN 1 ELSE 0 END) OVER w AS g2,
    sum(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER w AS g3 FROM e WHERE kind = 'heading' WINDOW w AS (PARTITION BY doc_id ORDER BY element_index ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g2 ORDER BY element_index ROWS UNBOUNDED PRECEDING) AS n2,
    sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g3 ORDER BY element_index ROWS UNBOUNDED PRECEDING) AS n3 FROM h)
SELECT doc_id, element_index, concat_ws('.', CAST(n1 AS BIGINT), CASE WHEN level >= 2 THEN CAST(n2 AS BIGINT) END, CASE WHEN level >= 3 THEN CAST(n3 AS BIGINT) END) AS label FROM k""")
def heading_stack(spark, d):
    """Numbers of headings by level: a level's count begins anew under each shallower heading."""
    h = elements(spark, d, "kind", "level").where("kind = 'heading'").select("doc_id", "element_index", "level")
    lev = F.col("level")
    one = lambda c: F.when(c, 1).otherwise(0)
    h = running(h, "doc_id", ["element_index"], sums={"n1": one(lev == 1), "g3": one(lev <= 2), "all2": one(lev == 2), "all3": one(lev == 3)})
    # a count since the last reset is the running count less its value at the reset
    since = h.groupBy("doc_id", "n1").agg(F.min(F.col("all2") - one(lev == 2)).alias("b2"))
    since3 = h.groupBy("doc_id", "g3").agg(F.min(F.col("all3") - one(lev == 3)).alias("b3"))
    h = h.join(since, ["doc_id", "n1"]).join(since3, ["doc_id", "g3"])
    label = F.concat_ws(".", F.col("n1").cast("string"), F.when(lev >= 2, (F.col("all2") - F.col("b2")).cast("string")), F.when(lev >= 3, (F.col("all3") - F.col("b3")).cast("string")))
    return h.select("doc_id", "element_index", label.alias("label"))


@query("WIN-7", f"""
WITH {CELLS} SELECT doc_id, element_index, r, c, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY doc_id, element_index, c ORDER BY r ROWS UNBOUNDED PRECEDING) AS text FROM cells""")
def vertical_fill(spark, d):
    """Blank cells take the text of the nearest filled cell above; a table is one element, so its window is small."""
    w = W.partitionBy("doc_id", "element_index", "c").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    return cells_of(elements(spark, d, "kind", "rows")).select("doc_id", "element_index", "r", "c", F.last(F.nullif(F.col("text"), F.lit("")), ignorenulls=True).over(w).alias("text"))


MOST_NEAR = 400  # fixed value: signs of a neighbour that are kept


@query("WIN-8", f"""
WITH {E}, x AS (SELECT doc_id, element_index, left(text, {MOST_NEAR}) AS s FROM e WHERE text <> '')
SELECT doc_id, element_index, coalesce(list(s) OVER (PARTITION BY doc_id ORDER BY element_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS before,
  coalesce(list(s) OVER (PARTITION BY doc_id ORDER BY element_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS after FROM x""")
def neighbours_k3(spark, d):
    """The texts, up to 400 signs of each, of the three filled elements before and after each."""
    e = elements(spark, d, F.substring("text", 1, MOST_NEAR).alias("s")).where("s <> ''")
    return neighbours(e, "doc_id", ["element_index"], "s", 3).select("doc_id", "element_index", "before", "after")


CAP = "(length(trim({0})) <= 200 AND regexp_matches(trim({0}), '(?i)^\\s*(hình|biểu đồ|sơ đồ|ảnh|bảng|figure|table)\\s*[0-9.]*\\s*[:.\\-]?\\s*\\S+'))"


@query("WIN-9 FUN-S16", f"""
WITH {E}, x AS (SELECT doc_id, element_index, kind, coalesce(text, '') AS text FROM e WHERE kind = 'image' OR text <> ''),
 n AS (SELECT *, lead(nullif(text, '') IGNORE NULLS) OVER w AS nxt, lag(nullif(text, '') IGNORE NULLS) OVER w AS prv FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY element_index))
SELECT doc_id, element_index, CASE WHEN {CAP.format("text")} THEN 'self' WHEN {CAP.format("nxt")} THEN 'after' WHEN {CAP.format("prv")} THEN 'before' ELSE 'none' END AS caption_from FROM n WHERE kind = 'image'""")
def caption_search(spark, d):
    """Where an image's caption stands: in its own paragraph, right after, right before. The nearest filled text on either
    side comes from two running values, so that no window holds a whole document."""
    filled = F.col("text") != ""
    x = elements(spark, d, "kind", F.when(filled, X.is_caption(F.col("text"))).alias("cap"))  # whether it is one is all that is carried
    x = x.where("kind = 'image' or cap is not null")
    x = running(x, "doc_id", ["element_index"], lasts={"prv": F.col("cap")}, inclusive=False).withColumn("back", -F.col("element_index"))
    x = running(x, "doc_id", ["back"], lasts={"nxt": F.col("cap")}, inclusive=False)
    src = F.when(F.col("cap"), "self").when(F.col("nxt"), "after").when(F.col("prv"), "before").otherwise("none")
    return x.where("kind = 'image'").select("doc_id", "element_index", src.alias("caption_from"))


@query("WIN-11 WIN-12", f"""
WITH {CELLS}, r AS (SELECT doc_id, element_index, r, count(*) FILTER (WHERE trim(text) <> '') AS filled, count(DISTINCT trim(text)) FILTER (WHERE trim(text) <> '') AS kinds, min(trim(text)) FILTER (WHERE trim(text) <> '') AS label,
   bool_or(regexp_matches(text, '[0-9]')) AS has_digit FROM cells GROUP BY 1, 2, 3)
SELECT doc_id, element_index, r, last_value(CASE WHEN filled >= 2 AND kinds = 1 AND NOT regexp_full_match(label, '[0-9.,%\\s]+') THEN label END IGNORE NULLS)
   OVER (PARTITION BY doc_id, element_index ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS band FROM r""")
def band_rows(spark, d):
    """The label of the band that a row of a stacked table stands in: the nearest row above whose cells are all equal."""
    filled = F.when(F.trim("text") != "", F.trim("text"))
    r = cells_of(elements(spark, d, "kind", "rows")).groupBy("doc_id", "element_index", "r").agg(F.count(filled).alias("filled"), F.min(filled).alias("label"), F.max(filled).alias("top"))
    band = F.when((F.col("filled") >= 2) & (F.col("label") == F.col("top")) & ~F.col("label").rlike(r"^[0-9.,%\s]+$"), F.col("label"))
    w = W.partitionBy("doc_id", "element_index").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    return r.select("doc_id", "element_index", "r", F.last(band, ignorenulls=True).over(w).alias("band"))


@query("JOIN-5 WIN-3", f"""
WITH {E}, m AS (SELECT doc_id, element_index AS start, text AS owner, section AS msec FROM e WHERE kind = 'heading'),
 s AS (SELECT *, min(start) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM m)
SELECT x.doc_id, x.element_index, s.owner FROM e x LEFT JOIN s ON s.doc_id = x.doc_id AND s.start <= x.element_index AND (s.stop IS NULL OR x.element_index < s.stop)
  AND upper(trim(split_part(coalesce(s.msec, ''), '.', 1))) = upper(trim(split_part(coalesce(x.section, ''), '.', 1))) WHERE x.kind = 'table'""")
def interval_owner(spark, d):
    """Each table's owner: the marker whose interval holds it, within the same root section. The intervals of a document
    don't overlap, so the interval join is the last marker at or before the table, kept if the sections agree."""
    mark = F.when(F.col("kind") == "heading", F.struct(F.col("text").alias("owner"), X.section_root(F.col("section")).alias("root"))).alias("mark")
    e = elements(spark, d, "kind", X.section_root(F.col("section")).alias("root"), mark)
    r = running(e, "doc_id", ["element_index"], lasts={"m": F.col("mark")})
    return r.where("kind = 'table'").select("doc_id", "element_index", F.when(F.col("m.root") == F.col("root"), F.col("m.owner")).alias("owner"))


@query("JOIN-6", f"""
WITH {E}, i AS (SELECT doc_id, element_index AS at, coalesce(lag(element_index) OVER (PARTITION BY doc_id ORDER BY element_index), -1) AS lo FROM e WHERE kind = 'image')
SELECT i.doc_id, i.at AS element_index, CAST(max(h.element_index) AS INT) AS heading_index FROM i LEFT JOIN e h ON h.doc_id = i.doc_id AND h.kind = 'heading' AND h.element_index > i.lo AND h.element_index <= i.at GROUP BY 1, 2""")
def asof_heading(spark, d):
    """The nearest heading before each image that comes after the image before."""
    e = elements(spark, d, "kind")
    r = running(e, "doc_id", ["element_index"], lasts={"h": F.when(F.col("kind") == "heading", F.col("element_index"))})
    r = running(r, "doc_id", ["element_index"], lasts={"lo": F.when(F.col("kind") == "image", F.col("element_index"))}, inclusive=False)
    return r.where("kind = 'image'").select("doc_id", "element_index", F.when(F.col("h") > F.coalesce("lo", F.lit(-1)), F.col("h")).alias("heading_index"))


@query("AGG-9 FUN-A7 ORD-14 ORD-16", f"""
WITH {E}, x AS (SELECT CASE kind WHEN 'image' THEN 1 WHEN 'table' THEN 2 ELSE 9 END AS prio, kind, doc_id || '#' || element_index AS at FROM e)
SELECT kind, CAST(prio AS INT) AS prio, CAST(count(*) AS BIGINT) AS n, list_slice(list_sort(list(x.at)), 1, 5) AS first_five, CAST(greatest(count(*) - 5, 0) AS BIGINT) AS more FROM x GROUP BY 1, 2""")
def kinds_first_five(spark, d):
    """Kinds in a fixed order with their count and first five places; the five least are kept by rank, never the whole list."""
    x = elements(spark, d, "kind").select("kind", F.concat("doc_id", F.lit("#"), F.col("element_index").cast("string")).alias("at"))
    top = x.withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy("at"))).where("k <= 5").groupBy("kind").agg(F.array_sort(F.collect_list("at")).alias("first_five"))
    prio = F.when(F.col("kind") == "image", 1).when(F.col("kind") == "table", 2).otherwise(9)
    n = x.groupBy("kind").agg(F.count("*").alias("n"))
    return n.join(top, "kind").select("kind", prio.alias("prio"), "n", "first_five", F.greatest(F.col("n") - 5, F.lit(0)).alias("more"))


@query("WIN-17 WIN-20", f"""
WITH {E} SELECT doc_id, element_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY element_index) AS BIGINT) AS no, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS of_all FROM e WHERE kind = 'image'""")
def image_numbering(spark, d):
    e = elements(spark, d, "kind").where("kind = 'image'").select("doc_id", "element_index")
    r = running(e, "doc_id", ["element_index"], sums={"no": F.lit(1)})
    return r.join(e.groupBy("doc_id").agg(F.count("*").alias("of_all")), "doc_id").select("doc_id", "element_index", F.col("no").cast("long").alias("no"), "of_all")


FEW = 200  # fixed value: quotes of a document up to which each of its texts is compared with all of them


@query("JOIN-14 FUN-S1 ORD-6", f"""
WITH {E}, k AS (SELECT DISTINCT nhan_xet_id, doc_id, lower(trim(regexp_replace(trich_dan_tai_lieu, '{WS}', ' ', 'g'))) AS k FROM nhan_xet_dinh_tinh WHERE trich_dan_tai_lieu <> ''),
 x AS (SELECT doc_id, element_index, kind, lower(trim(regexp_replace(regexp_replace(text, '^\\s*\\[[^\\]]{{0,80}}\\]\\s*', ''), '{WS}', ' ', 'g'))) AS nt FROM e WHERE text <> ''),
 m AS (SELECT k.nhan_xet_id, x.element_index, row_number() OVER (PARTITION BY k.nhan_xet_id ORDER BY CASE WHEN x.kind = 'paragraph' THEN 0 ELSE 1 END, x.element_index) AS r FROM k JOIN x ON x.doc_id = k.doc_id AND contains(x.nt, k.k) WHERE length(k.k) >= 30 AND k.k LIKE '% % %')
SELECT nhan_xet_id, element_index FROM m WHERE r = 1""")
def quote_anchor(spark, d):
    """The first element that contains a quote, paragraphs before other kinds. A document with few quotes sends them all to
    each of its texts. In one with many, a text that contains a quote holds each run of the quote's inner words: quotes are
    looked up by the run that the fewest texts of the document hold, so that what all texts say makes no pairs."""
    quotes = t(spark, d, "nhan_xet_dinh_tinh").where("trich_dan_tai_lieu <> ''")
    many = F.broadcast(quotes.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("doc_id"))  # a FEW-th of the quotes at most
    raw = t(spark, d, "elements").where("doc_id is not null and element_index is not null and text <> ''").select("doc_id", "element_index", "kind", "text")

    def quoted(side):
        q = quotes.join(many, "doc_id", side).select("nhan_xet_id", "doc_id", F.lower(X.squeeze(F.col("trich_dan_tai_lieu"))).alias("k"))
        return q.where((F.length("k") >= 30) & F.col("k").like("% % %")).distinct()

    def texts(e):
        return e.select("doc_id", "element_index", F.when(F.col("kind") == "paragraph", 0).otherwise(1).alias("other"), F.coalesce(X.norm(F.col("text")), F.lit("")).alias("nt"), *[c for c in e.columns if c == "lengths"])

    few = quoted("left_anti").groupBy("doc_id").agg(F.collect_list(F.struct("nhan_xet_id", "k")).alias("q"))
    held = F.filter("q", lambda q: F.contains(F.col("nt"), q["k"]))
    direct = texts(raw.join(many, "doc_id", "left_anti")).join(few.hint("shuffle_hash"), "doc_id").select(F.explode(held["nhan_xet_id"]).alias("nhan_xet_id"), "other", "element_index")

    q = cut(quoted("left_semi"))
    keys = q.select("doc_id", "k").distinct().withColumn("w", F.split("k", " ")).withColumn("w", F.slice("w", 2, F.size("w") - 2))
    keys = keys.withColumn("n", F.when(F.size("w") >= 8, 8).when(F.size("w") >= 4, 4).otherwise(F.least(F.size("w"), F.lit(2))))
    runs = keys.select("doc_id", "k", F.explode(F.array_distinct(X.run_hashes("w", F.col("n")))).alias("h"))
    lengths = F.broadcast(keys.groupBy("doc_id").agg(F.collect_set("n").alias("lengths")))  # no more rows than many
    words = texts(raw.join(lengths, "doc_id")).withColumn("w", F.split("nt", " "))
    hits = words.select("doc_id", "element_index", F.explode(F.array_distinct(F.flatten(F.transform("lengths", lambda n: X.run_hashes("w", n))))).alias("h"))
    hits = cut(hits.join(runs.select("doc_id", "h").distinct().hint("shuffle_hash"), ["doc_id", "h"], "left_semi").distinct())
    # a run that no text holds counts 0: its quote stands nowhere
    rarest = runs.join(hits.groupBy("doc_id", "h").agg(F.count("*").alias("n")), ["doc_id", "h"], "left").groupBy("doc_id", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("r"))
    near = hits.join(rarest.where("r.n > 0").select("doc_id", "k", "r.h"), ["doc_id", "h"]).select("doc_id", "element_index", "k")
    m = texts(raw.join(many, "doc_id", "left_semi")).join(near, ["doc_id", "element_index"]).where(F.contains("nt", "k")).groupBy("doc_id", "k").agg(F.min(F.struct("other", "element_index")).alias("at"))
    found = direct.unionByName(q.join(m, ["doc_id", "k"]).select("nhan_xet_id", "at.other", "at.element_index"))
    return found.groupBy("nhan_xet_id").agg(F.min(F.struct("other", "element_index"))["element_index"].alias("element_index"))


@query("FUN-S2 FUN-S15", f"""
WITH {E} SELECT doc_id, element_index, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key, regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g') AS instance FROM e WHERE kind = 'heading'""")
def text_keys(spark, d):
    e = elements(spark, d, "kind", "text").where("kind = 'heading'")
    return e.select("doc_id", "element_index", X.fold_key(F.col("text")).alias("key"), X.instance_key(F.col("text")).alias("instance"))


@query("FUN-S3", f"WITH {E} SELECT doc_id, element_index, translate(strip_accents(text), 'đĐ', 'dD') AS plain FROM e WHERE kind = 'heading'")
def strip_diacritics(spark, d):
    e = elements(spark, d, "kind", "text").where("kind = 'heading'")
    return e.select("doc_id", "element_index", X.strip_accents(F.col("text")).alias("plain"))


@query("FUN-S6 FUN-S7 PRJ-3", f"""
WITH {E}, s AS (SELECT doc_id, element_index, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS s FROM e WHERE kind = 'paragraph'), x AS (SELECT *, replace(s, '|', '\\|') AS m FROM s)
SELECT doc_id, element_index, CASE WHEN length(s) <= 60 THEN s ELSE (CASE WHEN contains(left(s, 60), ' ') THEN regexp_extract(left(s, 60), '^(.*) ', 1) ELSE left(s, 60) END) || '…' END AS short,
  CASE WHEN length(m) <= 170 THEN m ELSE rtrim(left(m, 169)) || '…' END AS cell FROM x""")
def cut_texts(spark, d):
    """Every paragraph cut behind a word, and as a cell of a Markdown table."""
    e = elements(spark, d, "kind", "text").where("kind = 'paragraph'")
    return e.select("doc_id", "element_index", X.cut_at_word(F.col("text"), 60).alias("short"), X.table_cell(F.col("text")).alias("cell"))


@query("FUN-S18 FUN-S19 AGG-30", f"""
WITH {E}, x AS (SELECT doc_id, coalesce(page, 0) AS page, text FROM e WHERE kind = 'paragraph' AND text <> '')
SELECT doc_id, CAST(page AS INT) AS page, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\n+'), lambda s: length(trim(s)) > 25))) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE regexp_matches(lower(text), 'mục\\s*[ivx]+')) AS BIGINT) AS citing
FROM x GROUP BY 1, 2""")
def coverage_by_page(spark, d):
    """Lines of text and elements that cite a section, by page."""
    x = elements(spark, d, "kind", "page", "text").where("kind = 'paragraph' and text <> ''")
    lines = F.size(F.filter(F.split("text", r"\n+"), lambda s: F.length(F.trim(s)) > 25))
    return x.groupBy("doc_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.sum(lines).alias("lines"), F.count_if(F.lower("text").rlike(r"mục\s*[ivx]+")).alias("citing"))


@query("RUL-22 FLT-16", f"""
WITH {HEAD} SELECT n.doc_id, n.element_index, n.c, CASE WHEN regexp_matches(lower(n.text), '%') THEN '%' WHEN regexp_matches(lower(n.text), 'iops') THEN 'iops' WHEN regexp_matches(lower(n.text), '(mb|gb)/s|[mg]bps') THEN 'bang_thong'
  WHEN regexp_matches(lower(n.text), '(^|[^a-z])gb([^a-z]|$)') THEN 'gb' WHEN regexp_matches(lower(n.text), 'cpu|cores?|cint') THEN 'cpu' WHEN regexp_matches(lower(n.text), 'tps|cps') THEN 'tps' ELSE '' END AS family FROM num n WHERE n.r = 0""")
def unit_family_of_column(spark, d):
    """The family of units that a header speaks of: an ordered ladder, the first sign counts."""
    low = F.lower("text")
    fam = (F.when(low.contains("%"), "%").when(low.contains("iops"), "iops").when(low.rlike("(mb|gb)/s|[mg]bps"), "bang_thong").when(low.rlike("(^|[^a-z])gb([^a-z]|$)"), "gb")
           .when(low.rlike("cpu|cores?|cint"), "cpu").when(low.rlike("tps|cps"), "tps").otherwise(""))
    return cells_of(elements(spark, d, "kind", "rows")).where("r = 0").select("doc_id", "element_index", "c", fam.alias("family"))


@query("AGG-28 ORD-7 AGG-31", """
WITH x AS (SELECT source, doc_id, modified, length(coalesce(text, '')) AS n FROM documents WHERE source IS NOT NULL)
SELECT source, max_by(doc_id, (modified, doc_id)) FILTER (WHERE modified IS NOT NULL) AS latest, max_by(doc_id, (n, doc_id)) AS richest FROM x GROUP BY 1""")
def latest_per_key(spark, d):
    """The latest and the richest document of each dossier, ties by id; both combine before the shuffle."""
    x = t(spark, d, "documents").where("source is not null").select("source", "doc_id", "modified", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return x.groupBy("source").agg(F.max_by("doc_id", F.when(F.col("modified").isNotNull(), F.struct("modified", "doc_id"))).alias("latest"), F.max_by("doc_id", F.struct("n", "doc_id")).alias("richest"))


@query("AGG-18", """
WITH x AS (SELECT md5(text) AS h, doc_id FROM documents WHERE text <> '')
SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM x GROUP BY h""")
def dedup_keep_first_count(spark, d):
    """Exact copies: the least id of each text and how many there are. Only hashes are shuffled."""
    x = t(spark, d, "documents").where("text <> ''").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))
    return x.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("AGG-17", """
WITH c AS (SELECT loai, vong, source, count(*) AS n FROM documents WHERE loai IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY loai, vong ORDER BY n DESC, source DESC) AS k FROM c WHERE source IS NOT NULL)
SELECT loai, vong, source, CAST(n AS BIGINT) AS n FROM r WHERE k = 1""")
def dedup_max_multiplicity(spark, d):
    """For each (kind, round) the source that says it most often; ties to the greater name."""
    c = t(spark, d, "documents").where("loai is not null and source is not null").groupBy("loai", "vong", "source").agg(F.count("*").alias("n"))
    return c.groupBy("loai", "vong").agg(F.max(F.struct("n", "source")).alias("b")).select("loai", "vong", "b.source", "b.n")


@query("SET-4 SET-6 SET-7", """
WITH w AS (SELECT item_id, category, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1)) AS t FROM eval_items)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) * 1.0 / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard, round(2.0 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)), 6) AS f1
FROM w a JOIN w b ON a.category = b.category AND a.item_id + 1 = b.item_id""")
def token_similarity(spark, d):
    """Word-set similarity of consecutive items of a category."""
    w = t(spark, d, "eval_items").select("item_id", "category", F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 1)).alias("t"))
    a, b = w.select(F.col("item_id").alias("a"), "category", F.col("t").alias("ta"), (F.col("item_id") + 1).alias("b")), w.select(F.col("item_id").alias("b"), "category", F.col("t").alias("tb"))
    return a.join(b, ["b", "category"]).select("a", "b", F.round(X.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"), F.round(X.token_f1(F.col("ta"), F.col("tb")), 6).alias("f1"))


def _label_sql() -> str:
    """The labels column by column, as a list of parts a row; a column is passed over once all rows are told apart."""
    named = "list_transform(parts, lambda p: array_to_string(p, ' / '))"
    col = "list_transform(data, lambda r: trim(coalesce(r[c + 1], '')))"
    number = "regexp_matches(x, '[0-9]') AND regexp_full_match(x, '[\\s0-9.,]{1,12}[%A-Za-zÀ-ỹ/()\\s]{0,10}')"
    return f"""{HEAD}, base AS (SELECT tb.doc_id, tb.element_index, tb.rows[h.n_head + 1:] AS data, coalesce(list_max(list_transform(tb.rows[h.n_head + 1:], lambda x: len(x))), 0) AS w FROM tb JOIN head h USING (doc_id, element_index)),
 step AS (WITH RECURSIVE s(doc_id, element_index, data, w, c, parts) AS (SELECT doc_id, element_index, data, w, 0, list_transform(data, lambda r: CAST([] AS VARCHAR[])) FROM base
   UNION ALL SELECT doc_id, element_index, data, w, c + 1, CASE WHEN
      (len(list_filter({col}, lambda x: x <> '')) > 0 AND len(list_filter({col}, lambda x: x <> '' AND NOT ({number}))) = 0) OR (len(list_filter({named}, lambda x: x = '')) = 0 AND len(list_distinct({named})) = len(parts)) OR coalesce(list_max(list_transform(parts, lambda p: len(p))), 0) >= 3
      THEN parts ELSE list_transform(parts, lambda p, i: CASE WHEN trim(coalesce(data[i][c + 1], '')) = '' OR list_contains(p, trim(coalesce(data[i][c + 1], ''))) THEN p ELSE list_append(p, trim(coalesce(data[i][c + 1], ''))) END) END
     FROM s WHERE c < w) SELECT * FROM s WHERE c = w),
 lab AS (SELECT doc_id, element_index, CASE WHEN len(list_filter({named}, lambda x: x <> '')) = 0 THEN list_transform(data, lambda r: trim(coalesce(r[1], ''))) ELSE {named} END AS l FROM step)"""


@query("FUN-A6", f"WITH {_label_sql()} SELECT doc_id, element_index, CAST(k - 1 AS INT) AS k, l[k] AS label FROM (SELECT doc_id, element_index, l, unnest(range(1, len(l) + 1)) AS k FROM lab)")
def row_labels(spark, d):
    """A label for each data row of every table, of as many columns as it takes to tell the rows apart."""
    e = elements(spark, d, "kind", "rows").where("kind = 'table'")
    return e.select("doc_id", "element_index", F.posexplode(R.row_labels(F.col("rows"))).alias("k", "label"))
