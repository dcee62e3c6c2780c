"""Queries over single values and cells: formulas, searches in columns, gates, messages, formats, logs of work done."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizelake.functions import images as I
from sizelake.functions import numbers as N
from sizelake.functions import text as X
from sizelake.functions.cell_formulas import formula, has_factor, reserve_states
from sizelake.functions.json_walk import json_leaves
from sizelake.operators.matching import balanced
from sizelake.operators.quantities import normalised_images, rule_targets
from sizelake.operators.sinks import retries
from sizelake.plans import amount_sql
from sizelake.plans.documents import CELLS, WS, cells_of, elements
from sizelake.plans.registry import query
from sizelake.sources.tables import table as t


@query("RUL-11 FUN-M9 FUN-M10", """
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_linenumber AS n, CAST(l_quantity AS INT) * l_linenumber + CASE WHEN l_orderkey % 5 = 0 THEN 20 ELSE 0 END AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, abs(q * n - r) <= greatest(r * 0.005, 0.5) AS holds, CASE WHEN abs(q * n - r) <= greatest(r * 0.005, 0.5) THEN n = 2 END AS doubled FROM x""")
def formula_cells(spark, d):
    """Formulas in cells recomputed within the rounding of what is printed, and whether they multiply by two."""
    li = t(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    r = q * F.col("l_linenumber") + F.when(F.col("l_orderkey") % 5 == 0, 20).otherwise(0)
    cell = F.concat(F.lit("= "), q.cast("string"), F.lit(" * "), F.col("l_linenumber").cast("string"), F.lit(" = "), r.cast("string"))
    f = li.select("l_orderkey", "l_linenumber", formula(cell).alias("f"))
    return f.select("l_orderkey", "l_linenumber", (F.size("f.holds") > 0).alias("holds"), has_factor(F.col("f"), F.lit(2.0)).alias("doubled"))


@query("RUL-12", """
WITH x AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS INT) AS q, l_returnflag AS fl, l_orderkey % 11 = 0 AS wrong FROM lineitem),
 f AS (SELECT *, CASE n % 4 WHEN 0 THEN 12 * q WHEN 1 THEN 10 * q WHEN 2 THEN 11 * q ELSE 10 * q + 5 END AS v FROM x),
 up AS (SELECT DISTINCT a.o, a.n FROM f a JOIN f b ON a.o = b.o AND a.n <> b.n AND NOT a.wrong AND NOT b.wrong AND ((b.n % 4 = 2 AND abs(10 * b.q - a.v) <= a.v * 0.005) OR (b.n % 4 = 0 AND (abs(b.q - a.v) <= a.v * 0.005 OR abs(10 - a.v) <= a.v * 0.005))))
SELECT f.o AS l_orderkey, f.n AS l_linenumber, CASE fl WHEN 'R' THEN 'load balancer' WHEN 'A' THEN 'firewall' END AS device,
 CASE WHEN wrong THEN 'no arithmetic' WHEN fl NOT IN ('R', 'A') THEN 'out of scope' WHEN f.n % 4 = 3 THEN 'sum' WHEN up.o IS NOT NULL THEN 'intermediate' WHEN f.n % 4 = 0 THEN 'has factor' ELSE 'lacks factor' END AS state, CAST(count(*) AS BIGINT) AS cells
FROM f LEFT JOIN up ON up.o = f.o AND up.n = f.n GROUP BY ALL""")
def reserve_factor(spark, d):
    """Whether formulas for the throughput of network devices multiply by the reserve factor; an order's lines are the cells
    of a table, each with a formula of its own kind."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 4
    off = F.when(F.col("l_orderkey") % 11 == 0, 100).otherwise(0)
    text = lambda left, v: F.concat(F.lit("= "), *left, F.lit(" = "), (v + off).cast("string"))
    cell = (F.when(n == 0, text([q.cast("string"), F.lit(" * 10 * 1.2")], 12 * q)).when(n == 1, text([q.cast("string"), F.lit(" * 10")], 10 * q))
            .when(n == 2, text([(10 * q).cast("string"), F.lit(" * 1.1")], 11 * q)).otherwise(text([(10 * q).cast("string"), F.lit(" + 5")], 10 * q + 5)))
    about = F.when(F.col("l_returnflag") == "R", "vLB · thông lượng").when(F.col("l_returnflag") == "A", "Tường lửa, lưu lượng").otherwise("Máy chủ")
    c = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("cell"), cell.alias("text"), about.alias("context"))
    return reserve_states(c).groupBy(F.col("table").alias("l_orderkey"), F.col("cell").alias("l_linenumber"), "device", "state").agg(F.count("*").alias("cells"))


@query("JOIN-15", f"""
WITH {CELLS}, h AS (SELECT doc_id, element_index, c, text AS header FROM cells WHERE r = 0 AND (lower(trim(text)) = 'ram (gb)' OR contains(lower(text), 'ram')))
SELECT b.doc_id, b.element_index, min(b.r) AS r FROM cells b JOIN h USING (doc_id, element_index, c) WHERE b.r > 0 AND contains(b.text, '16') GROUP BY 1, 2""")
def column_search(spark, d):
    """In tables with a column about RAM, the first row whose cell there holds 16."""
    c = cells_of(elements(spark, d, "kind", "rows"))
    h = c.where("r = 0").where((F.lower(F.trim("text")) == "ram (gb)") | F.lower("text").contains("ram")).select("doc_id", "element_index", "c")
    b = c.where("r > 0").where(F.col("text").contains("16")).select("doc_id", "element_index", "c", "r")
    return b.join(h, ["doc_id", "element_index", "c"]).groupBy("doc_id", "element_index").agg(F.min("r").alias("r"))


@query("FLT-4 FLT-5 RUL-7", """
SELECT DISTINCT rule_id, name, CASE WHEN coalesce(trim(unit), '') = '' THEN 'no unit' WHEN role = 'lookup' THEN 'look-up table missing' WHEN NOT required THEN 'optional' ELSE 'runnable' END AS reason
FROM rule_inputs WHERE (rule_id LIKE 'DL-1%' OR role = 'lookup') AND name IS NOT NULL""")
def rule_selection(spark, d):
    """Selected by optional criteria, with why each can or can't run."""
    r = t(spark, d, "rule_inputs").where((F.col("rule_id").like("DL-1%") | (F.col("role") == "lookup")) & F.col("name").isNotNull())
    why = F.when(F.coalesce(F.trim("unit"), F.lit("")) == "", "no unit").when(F.col("role") == "lookup", "look-up table missing").when(~F.col("required"), "optional").otherwise("runnable")
    return r.select("rule_id", "name", why.alias("reason")).distinct()


@query("FUN-M8", amount_sql.GATE)
def value_gate(spark, d):
    """Every number read from an image brought to the unit of its rule, or why that can't be done."""
    u, r = t(spark, d, "units"), t(spark, d, "rule_inputs")
    x = normalised_images(t(spark, d, "so_lieu_anh"), u, r).select("number_id", "name", "amount", "dims").distinct()
    x = x.join(rule_targets(u, r), "name", "left")
    out = (F.when(F.col("amount").isNull(), "no value").when(F.col("dims") == "none^1", "no unit").when(F.col("rule_dims").isNull(), "rule without unit").when(F.col("dims") != F.col("rule_dims"), "other kind")
           .when(F.abs(F.col("amount") / F.col("rule_factor")) > 1e6, "out of range").otherwise("ok"))
    return x.select("number_id", out.alias("outcome"))


@query("FUN-M4 FUN-M5 FUN-M6 FUN-M7 FLT-11", amount_sql.CONVERTED)
def unit_convert(spark, d):
    """Every number read from an image as an amount in the base unit of its group; entries that are no single value, that have
    no unit, a unit without a factor or one that nobody knows are typed outcomes."""
    x = normalised_images(t(spark, d, "so_lieu_anh"), t(spark, d, "units"), t(spark, d, "rule_inputs")).select("number_id", "amount", "dims", "base_unit").distinct()
    state = (F.when(F.col("amount").isNull(), "no value").when(F.col("dims") == "none^1", "no unit").when(F.col("dims").startswith("unit:"), "not convertible").when(F.col("dims").contains("word:"), "unknown unit").otherwise("converted"))
    return x.select("number_id", F.when(~state.isin("no value", "unknown unit"), F.when(F.abs("amount") >= 1e9, F.round("amount", 0)).otherwise(F.round("amount", 3))).alias("amount"), F.when(state.isin("converted", "not convertible"), F.col("base_unit")).alias("base"), state.alias("state"),
                    F.coalesce((state == "converted") & F.col("amount").between(1, 1e15), F.lit(False)).alias("in_range"))


@query("RUL-8 RUL-9 FUN-M12", """
SELECT o_orderkey, CASE WHEN l.o IS NULL THEN 'order check' ELSE 'order ' || o_orderkey || ' holds ' || CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE printf('%.2f', o_totalprice) END || ' over ' || l.n || ' lines' END AS message, l.first_flag AS location
FROM orders LEFT JOIN (SELECT l_orderkey AS o, count(*) AS n, min_by(l_returnflag, (l_linenumber, l_returnflag)) AS first_flag FROM lineitem GROUP BY 1) l ON l.o = o_orderkey""")
def message_templates(spark, d):
    """Messages from a template; where a value is missing the rule's name stands. The location is that of the first input."""
    li = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("location"))
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(li, "o_orderkey", "left")
    msg = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" holds "), N.whole_or_two(F.col("o_totalprice")), F.lit(" over "), F.col("n").cast("string"), F.lit(" lines"))
    return o.select("o_orderkey", F.coalesce(msg, F.lit("order check")).alias("message"), "location")


@query("RUL-10", f"""
WITH n AS (SELECT DISTINCT nhan_xet_id, doc_id, rule_id, ket_luan, lower(trim(regexp_replace(trich_dan_tai_lieu, '{WS}', ' ', 'g'))) AS q FROM nhan_xet_dinh_tinh WHERE regexp_matches(rule_id, '[0-9]$')),
 e AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS q FROM elements WHERE text <> '')
SELECT n.nhan_xet_id, CASE WHEN ket_luan = 'dat' THEN 'pass' WHEN coalesce(n.q, '') = '' THEN 'no quote' WHEN e.q IS NULL THEN 'unverifiable' WHEN CAST(right(rule_id, 1) AS INT) % 2 = 1 THEN 'missing_section' ELSE 'missing_info' END AS category
FROM n LEFT JOIN e ON e.doc_id = n.doc_id AND e.q = n.q""")
def verdict_mapping(spark, d):
    """Recorded verdicts as categories: a verdict whose quote is not found stays unverifiable."""
    q = lambda c: F.lower(X.squeeze(F.col(c)))
    n = t(spark, d, "nhan_xet_dinh_tinh").where(F.col("rule_id").rlike("[0-9]$")).select("nhan_xet_id", "doc_id", "rule_id", "ket_luan", q("trich_dan_tai_lieu").alias("q")).distinct()
    e = t(spark, d, "elements").where("text <> ''").select("doc_id", F.xxhash64(q("text")).alias("h"), F.xxhash64(F.lit(2), q("text")).alias("h2")).distinct().withColumn("hit", F.lit(True))
    j = n.withColumns({"h": F.xxhash64("q"), "h2": F.xxhash64(F.lit(2), "q")}).join(e, ["doc_id", "h", "h2"], "left")
    cat = (F.when(F.col("ket_luan") == "dat", "pass").when(F.coalesce("q", F.lit("")) == "", "no quote").when(F.col("hit").isNull(), "unverifiable")
           .when(F.right("rule_id", F.lit(1)).cast("int") % 2 == 1, "missing_section").otherwise("missing_info"))
    return j.select("nhan_xet_id", cat.alias("category"))


@query("RUL-15 FUN-A8", """
WITH r AS (SELECT DISTINCT id, snapshot_content FROM project_revisions WHERE json_valid(snapshot_content)), l AS (SELECT r.id, j.fullkey, j.type FROM r, json_tree(r.snapshot_content) j WHERE j.type NOT IN ('OBJECT', 'ARRAY'))
SELECT regexp_replace(replace(fullkey, '"', ''), '\\[[0-9]+\\]', '[]', 'g') AS path, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE type = 'NULL') AS BIGINT) AS nulls FROM l GROUP BY 1""")
def json_leaf_paths(spark, d):
    """Every leaf of JSON of unknown depth, counted by path."""
    r = t(spark, d, "project_revisions").select("id", "snapshot_content").distinct()
    x = r.select(F.explode(json_leaves("snapshot_content")).alias("l")).select("l.*")
    return x.groupBy(F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("path")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "null").alias("nulls"))


@query("FUN-S11", """
SELECT DISTINCT p_size AS n, CASE WHEN p_size > 26 THEN chr(CAST(96 + floor((p_size - 1) / 26) AS INT)) ELSE '' END || chr(CAST(97 + (p_size - 1) % 26 AS INT)) AS letters,
 repeat('X', CAST(floor(p_size / 10) AS INT) % 4 * CAST(p_size < 40 AS INT)) || CASE WHEN p_size = 50 THEN 'L' WHEN p_size >= 40 THEN 'XL' ELSE '' END || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_size % 10 + 1] AS roman FROM part WHERE p_size BETWEEN 1 AND 50""")
def numbering_labels(spark, d):
    p = t(spark, d, "part").where("p_size between 1 and 50").select(F.col("p_size").alias("n")).distinct()
    return p.select("n", X.bijective_letters(F.col("n")).alias("letters"), X.roman(F.col("n")).alias("roman"))


@query("FLT-27", """
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS line FROM documents WHERE text <> '')
SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE NOT regexp_matches(line, '^(/dev/|[0-9]{2}:[0-9]{2}:[0-9]{2} |> |root@)') AND trim(line) <> '') AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE regexp_matches(line, '[0-9]')) AS BIGINT) AS with_digits FROM l GROUP BY 1""")
def boilerplate_lines(spark, d):
    """Lines left when logs and quotations are taken out, and lines with digits; lines are counted within each text."""
    lines = F.split("text", r"\n")
    junk = r"^(/dev/|[0-9]{2}:[0-9]{2}:[0-9]{2} |> |root@)"
    n = lambda f: F.size(F.filter(lines, f)).cast("long")
    return t(spark, d, "documents").where("text <> ''").select("doc_id", F.size(lines).cast("long").alias("lines"), n(lambda x: ~x.rlike(junk) & (F.trim(x) != "")).alias("kept"), n(lambda x: x.rlike("[0-9]")).alias("with_digits"))


_CHANNEL = "greatest(0, least(255, {0}))"
_PX = f"list_transform(embedding, lambda v: {{{{'r': {_CHANNEL.format('base + CAST(floor(v * 300) AS INT)')}, 'g': {_CHANNEL.format('base + CAST(floor(v * 200) AS INT)')}, 'b': {_CHANNEL.format('base + tint')}}}}})".replace("{{", "{").replace("}}", "}")


@query("RUL-20 FLT-26 FUN-M13 FUN-M14 AGG-35", f"""
WITH b AS (SELECT vec_id, label, embedding, CASE WHEN vec_id % 3 = 0 THEN 30 WHEN vec_id % 3 = 1 THEN 235 ELSE 128 END AS base, CASE WHEN label % 2 = 0 THEN 60 ELSE 0 END AS tint FROM embeddings),
 p AS (SELECT vec_id, {_PX} AS px FROM b),
 f AS (SELECT vec_id, len(px) AS width, list_transform(px, lambda c: 0.299 * c.r + 0.587 * c.g + 0.114 * c.b) AS lu, list_transform(px, lambda c: CAST(greatest(c.r, c.g, c.b) AS DOUBLE)) AS mx, list_transform(px, lambda c: CAST(greatest(c.r, c.g, c.b) - least(c.r, c.g, c.b) AS DOUBLE)) AS sp,
   len(list_distinct(list_transform(px, lambda c: (c.r // 32) * 64 + (c.g // 32) * 8 + c.b // 32))) AS colours FROM p),
 m AS (SELECT vec_id, width, colours, list_avg(lu) / 255 AS luma, len(list_filter(lu, lambda x: x / 255 < 0.25)) / width AS dark, len(list_filter(sp, lambda x: x < 25)) / width AS grey,
   len(list_filter(range(1, width + 1), lambda i: sp[i] / greatest(mx[i], 1) >= 0.35 AND mx[i] >= 80)) / width AS vivid, len(list_filter(range(2, width + 1), lambda i: (lu[i] > 110) <> (lu[i - 1] > 110))) AS tr FROM f)
SELECT vec_id, CASE WHEN dark >= 0.6 THEN CASE WHEN tr >= 15 THEN 'console' WHEN tr <= 11.5 THEN 'dashboard' ELSE 'unknown' END WHEN luma >= 0.75 AND dark <= 0.15 THEN CASE WHEN colours >= 45 AND vivid >= 0.02 AND tr < 15 THEN 'diagram' WHEN grey >= 0.85 AND vivid < 0.02 THEN 'text' ELSE 'unknown' END ELSE 'unknown' END AS kind,
 round(luma, 6) AS luma, round(vivid, 6) AS vivid, CAST(tr AS DOUBLE) AS transitions, CAST(colours AS INT) AS colours, CASE WHEN vec_id % 5 = 0 THEN 2.0 ELSE CAST(width AS DOUBLE) END AS ratio FROM m""")
def image_kinds(spark, d):
    """Images through the whole chain: bytes, header, pixels, measures, kind, ratio. The tables hold no images, so that each
    vector is drawn as one, a line of pixels; every fifth is treated as one whose size only the page knows."""
    e = t(spark, d, "embeddings").where("embedding is not null").select("vec_id", "embedding", F.when(F.col("vec_id") % 3 == 0, 30).when(F.col("vec_id") % 3 == 1, 235).otherwise(128).alias("base"), F.when(F.col("label") % 2 == 0, 60).otherwise(0).alias("tint"))
    s = e.select("vec_id", I.image_stats(_drawn("embedding", "base", "tint")).alias("s"))
    vector = F.col("vec_id") % 5 == 0
    ratio = I.aspect_ratio(F.when(~vector, F.col("s.width")), F.when(~vector, F.col("s.height")), F.lit(19050), F.lit(9525))
    return s.select("vec_id", I.image_kind(F.col("s")).alias("kind"), F.round("s.luma", 6).alias("luma"), F.round("s.vivid", 6).alias("vivid"), "s.transitions", "s.colours", ratio.alias("ratio"))


@F.pandas_udf(T.BinaryType())
def _drawn(vectors: pd.Series, base: pd.Series, tint: pd.Series) -> pd.Series:
    out = []
    for v, b, c in zip(vectors, base, tint, strict=True):
        v = np.asarray(v, dtype=np.float32)
        px = np.stack((b + np.floor(v * np.float32(300)), b + np.floor(v * np.float32(200)), np.full(len(v), b + c)), axis=1)
        out.append(I.encode_png(np.clip(px, 0, 255)[None, :, :]))
    return pd.Series(out, dtype=object)


@query("SNK-1 SNK-3 SNK-11", """
SELECT '| ' || loai || ' | ' || vong || ' | ' || count(*) || ' |' AS line FROM documents WHERE loai IS NOT NULL AND vong IS NOT NULL GROUP BY loai, vong""")
def markdown_lines(spark, d):
    g = t(spark, d, "documents").where("loai is not null and vong is not null").groupBy("loai", "vong").agg(F.count("*").alias("n"))
    return g.select(F.concat(F.lit("| "), F.concat_ws(" | ", "loai", F.col("vong").cast("string"), F.col("n").cast("string")), F.lit(" |")).alias("line"))


@query("STR-6", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def pending_work(spark, d):
    """What a resumed run has still to do."""
    done = t(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("STR-7", """
WITH c AS (SELECT sha256(c_name || '|' || c_mktsegment) AS key, min(c_custkey) AS answer FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS key, c.answer FROM customer LEFT JOIN c ON c.key = sha256(c_name || '|' || c_mktsegment)""")
def memo_cache(spark, d):
    """Answers from a cache keyed by a hash of the inputs; failed ones are not in it."""
    c = t(spark, d, "customer").withColumn("key", F.sha2(F.encode(F.concat_ws("|", "c_name", "c_mktsegment"), "UTF-8"), 256))
    good = c.where("c_acctbal > 0").groupBy("key").agg(F.min("c_custkey").alias("answer"))
    return c.select("c_custkey", "key").join(good, "key", "left").select("c_custkey", "key", "answer")


@query("FUN-S22 FUN-S17", """
SELECT DISTINCT dossier_id, regexp_full_match(dau_moi_yeu_cau, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS is_mail, regexp_matches(lower(dossier), '^(image|picture|ảnh|hình)\\s*[0-9]*$') AS junk FROM eval_dossiers""")
def text_validators(spark, d):
    x = t(spark, d, "eval_dossiers")
    return x.select("dossier_id", X.is_email(F.col("dau_moi_yeu_cau")).alias("is_mail"), F.lower("dossier").rlike(r"^(image|picture|ảnh|hình)\s*[0-9]*$").alias("junk")).distinct()


@query("FUN-S9", "SELECT event_id, props AS found FROM events WHERE props IS NOT NULL")
def json_in_prose(spark, d):
    """The object within an answer that wraps it in prose and a code fence."""
    e = t(spark, d, "events").where("props is not null")
    answer = F.concat(F.lit("Here it is: ```json\n"), "props", F.lit("\n``` as asked"))
    return e.select("event_id", X.outer_json(answer).alias("found"))


@query("FUN-M11", """
SELECT o_orderkey, CASE WHEN v >= 9999.5 THEN regexp_replace(regexp_replace(printf('%.3e', v), '0+e', 'e'), '\\.e', 'e') WHEN v >= 999.95 THEN CASE WHEN v >= 999.95 AND printf('%.0f', v) = '1000' THEN '1,000' ELSE left(printf('%.0f', v), 1) || ',' || right(printf('%.0f', v), 3) END
 ELSE regexp_replace(regexp_replace(printf('%.1f', v), '0+$', ''), '\\.$', '') END AS shown FROM (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_totalprice >= 100)""")
def significant_digits(spark, d):
    """Totals with four significant digits."""
    o = t(spark, d, "orders").where("o_totalprice >= 100")
    return o.select("o_orderkey", N.four_digits(F.col("o_totalprice")).alias("shown"))


@query("FUN-M15", """
SELECT DISTINCT value_id, regexp_extract(gia_tri_nguyen_van, '([KMGTP]i?)B', 1) AS suffix, CASE left(regexp_extract(gia_tri_nguyen_van, '([KMGTP]i?)B', 1), 1) WHEN 'K' THEN 1024.0 WHEN 'M' THEN 1048576.0 WHEN 'G' THEN 1073741824.0 WHEN 'T' THEN 1099511627776.0 WHEN 'P' THEN 1125899906842624.0 END AS factor
FROM gia_tri_so WHERE regexp_matches(gia_tri_nguyen_van, '[KMGTP]i?B')""")
def suffix_factors(spark, d):
    g = t(spark, d, "gia_tri_so").where(F.col("gia_tri_nguyen_van").rlike("[KMGTP]i?B"))
    s = F.regexp_extract("gia_tri_nguyen_van", "([KMGTP]i?)B", 1)
    return g.select("value_id", s.alias("suffix"), N.suffix_factor(s).alias("factor")).distinct()


@query("WIN-19", """
WITH RECURSIVE s AS (SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS k FROM (SELECT category, count(*) AS n FROM eval_items GROUP BY 1)),
 g(k, category, half, dev, test) AS (SELECT 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT s.k, s.category, CASE WHEN dev <= test THEN 'dev' ELSE 'test' END, dev + CASE WHEN dev <= test THEN n ELSE 0 END, test + CASE WHEN dev <= test THEN 0 ELSE n END FROM g JOIN s ON s.k = g.k + 1)
SELECT category, half FROM g WHERE k > 0""")
def balanced_categories(spark, d):
    """Categories of the held-out items, a fixed list, assigned greedily to two halves, largest first."""
    sizes = [(r["category"], r["n"]) for r in t(spark, d, "eval_items").groupBy("category").agg(F.count("*").alias("n")).collect()]
    return spark.createDataFrame([(k, b) for k, b in balanced(sizes, ["dev", "test"]).items()], "category string, half string")


@query("SRC-20", """
SELECT CASE WHEN snapshot_content IS NULL THEN 'absent' WHEN NOT json_valid(snapshot_content) THEN 'broken' ELSE 'good' END AS state, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT id, snapshot_content FROM project_revisions) GROUP BY 1""")
def tolerant_json(spark, d):
    """Good, broken and absent JSON, none of it dropped."""
    r = t(spark, d, "project_revisions").select("id", "snapshot_content").distinct()
    ok = F.try_parse_json("snapshot_content").isNotNull()
    return r.groupBy(F.when(F.col("snapshot_content").isNull(), "absent").when(~ok, "broken").otherwise("good").alias("state")).agg(F.count("*").alias("n"))


@query("STR-9", """
WITH e AS (SELECT event_id, ts, CAST(event_id % 4 + 1 AS BIGINT) AS failed FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN failed > 3 THEN 'given up' ELSE 'retry' END AS state, CASE WHEN failed <= 3 THEN strftime(ts + to_milliseconds(CAST(5000 * 2 ** (failed - 1) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS next_at FROM e""")
def retry_queue(spark, d):
    """When what failed is tried again: the wait doubles with each failure, after three it is given up. How often an event has
    failed is laid out from its number."""
    e = t(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 4 + 1).alias("failed"))
    return retries(e, "ts", "failed").select("event_id", "state", F.date_format("next_at", "yyyy-MM-dd HH:mm:ss").alias("next_at"))


@query("SET-7", """
WITH n AS (SELECT DISTINCT nhan_xet_id, doc_id, rule_id FROM nhan_xet_dinh_tinh WHERE doc_id IS NOT NULL AND rule_id IS NOT NULL), f AS (SELECT doc_id, rule_id, min(nhan_xet_id) AS first FROM n GROUP BY 1, 2)
SELECT doc_id, list(rule_id ORDER BY first, rule_id) AS rules FROM f GROUP BY 1""")
def rules_in_order(spark, d):
    """The rules that a document's remarks name, each once, in the order in which they first come. The list is as long as the
    rule book at most, as rules are reduced to their first place before they are gathered."""
    f = t(spark, d, "nhan_xet_dinh_tinh").where("doc_id is not null and rule_id is not null").groupBy("doc_id", "rule_id").agg(F.min("nhan_xet_id").alias("first"))
    return f.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "rule_id")))["rule_id"].alias("rules"))


@query("SET-10", """
SELECT DISTINCT doc_id, element_index FROM elements e WHERE kind = 'image' AND doc_id IS NOT NULL AND element_index IS NOT NULL AND NOT EXISTS (SELECT 1 FROM so_lieu_anh s WHERE s.doc_id = e.doc_id AND s.page = e.page)""")
def images_without_numbers(spark, d):
    """Images on whose page no number was read from an image: what is there less what is referred to."""
    i = elements(spark, d, "kind", "page").where("kind = 'image'")
    return i.join(t(spark, d, "so_lieu_anh").select("doc_id", "page").where("page is not null").distinct(), ["doc_id", "page"], "left_anti").select("doc_id", "element_index")


@query("SRC-22", """
WITH e AS (SELECT DISTINCT doc_id, element_index, rows FROM elements WHERE kind = 'table' AND len(rows) > 0 AND doc_id IS NOT NULL AND element_index IS NOT NULL), r AS (SELECT doc_id, element_index, rows, unnest(range(len(rows))) AS r FROM e),
 c AS (SELECT doc_id, element_index, r, rows[r + 1] AS row, unnest(range(len(rows[r + 1]))) AS c FROM r)
SELECT doc_id, element_index, CAST(r AS INT) AS r, CAST(c AS INT) AS c, trim(regexp_replace(regexp_replace(coalesce(row[c + 1], ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM c""".replace("\t", "\\t").replace("\n{", "\\n{"))
def html_tables(spark, d):
    """Tables scraped from markup, the header as row 0. The tables of the documents are written as markup first, so that what
    is scraped can be compared with what was written."""
    esc = lambda x: F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit(f"<{tag} class='c'>"), esc(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: line(r, "td")), "\n")
    e = elements(spark, d, "kind", "rows").where("kind = 'table' and size(rows) > 0")
    page = e.select("doc_id", "element_index", F.concat(F.lit("<p>x</p><TABLE><thead>\n"), line(F.get("rows", F.lit(0)), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></TABLE>")).alias("html"))
    r = page.select("doc_id", "element_index", F.posexplode(X.html_table(F.col("html"))).alias("r", "row"))
    return r.select("doc_id", "element_index", "r", F.posexplode("row").alias("c", "text"))
