"""Queries for single functions and orders: dates, counts as maps, merged declarations, codes, evidence, recorded answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sizelake.functions import text as X
from sizelake.operators.matching import rank_in_key
from sizelake.plans.registry import query
from sizelake.plans.review import FIND, findings
from sizelake.sources.tables import table as t


@query("FUN-D4 FUN-D5 FUN-D6", """
SELECT o_orderkey, strftime(o_orderdate, '%-d/%-m/%Y') AS shown, CAST(epoch(TIMESTAMP '1998-09-01') - epoch(o_orderdate) AS BIGINT) AS elapsed, o_orderdate < TIMESTAMP '1998-09-01' - INTERVAL 365 DAY AS old FROM orders""")
def order_dates(spark, d):
    """Dates as written in Vietnam, seconds gone by since, and whether a row is older than a year."""
    now = F.lit("1998-09-01").cast("timestamp")
    at = F.col("o_orderdate").cast("timestamp")
    return t(spark, d, "orders").select("o_orderkey", F.date_format(at, "d/M/yyyy").alias("shown"), (F.unix_timestamp(now) - F.unix_timestamp(at)).alias("elapsed"), (at < now - F.expr("INTERVAL 365 DAY")).alias("old"))


@query("FUN-P3", """
WITH c AS (SELECT source, coalesce(loai, '?') AS loai, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2) SELECT source, list(loai || '=' || n ORDER BY loai) AS kinds FROM c GROUP BY 1""")
def kind_counts(spark, d):
    """Per dossier how many documents it has of each kind, as a map read off in order; counted before it is gathered."""
    c = t(spark, d, "documents").where("source is not null").groupBy("source", F.coalesce("loai", F.lit("?")).alias("loai")).agg(F.count("*").alias("n"))
    m = c.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("loai", "n"))).alias("m"))
    return m.select("source", F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("kinds"))


@query("AGG-20", """
WITH x AS (SELECT DISTINCT rule_id, name, nullif(trim(unit), '') AS unit, required, nullif(trim(default_value), '') AS dv FROM rule_inputs WHERE name IS NOT NULL AND rule_id IS NOT NULL)
SELECT name, CASE WHEN count(unit) > 0 THEN 'quantity' WHEN count(try_cast(dv AS DOUBLE)) > 0 THEN 'number' WHEN count(dv) > 0 THEN 'text' ELSE 'any' END AS kind, min_by(unit, (rule_id, unit)) FILTER (WHERE unit IS NOT NULL) AS unit, bool_or(required) AS required, list_sort(list_distinct(list(rule_id))) AS rules FROM x GROUP BY 1""")
def merged_parameters(spark, d):
    """The declarations of a parameter over all rules as one: the most specific kind, the first unit, the rules that use it."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    x = t(spark, d, "rule_inputs").where("name is not null and rule_id is not null").select("rule_id", "name", clean("unit").alias("unit"), "required", clean("default_value").alias("dv")).distinct()
    kind = F.when(F.count("unit") > 0, "quantity").when(F.count(F.col("dv").try_cast("double")) > 0, "number").when(F.count("dv") > 0, "text").otherwise("any")
    return x.groupBy("name").agg(kind.alias("kind"), F.min(F.when(F.col("unit").isNotNull(), F.struct("rule_id", "unit")))["unit"].alias("unit"), F.bool_or("required").alias("required"), F.sort_array(F.collect_set("rule_id")).alias("rules"))


@query("AGG-34", """
SELECT split_part(rule_id, '-', 1) AS grp, CAST(count(DISTINCT rule_id) AS BIGINT) AS rules, CAST(count(DISTINCT name) AS BIGINT) AS parameters, round(avg(CASE WHEN trim(unit) <> '' THEN 1.0 ELSE 0.0 END), 6) AS with_unit, CAST(count(*) FILTER (WHERE required) AS BIGINT) AS required FROM (SELECT DISTINCT rule_id, name, unit, required FROM rule_inputs WHERE rule_id IS NOT NULL) GROUP BY 1""")
def rule_coverage(spark, d):
    r = t(spark, d, "rule_inputs").where("rule_id is not null").select("rule_id", "name", "unit", "required").distinct()
    return r.groupBy(X.group_code(F.col("rule_id")).alias("grp")).agg(F.countDistinct("rule_id").alias("rules"), F.countDistinct("name").alias("parameters"), F.round(F.avg(F.when(F.trim("unit") != "", 1.0).otherwise(0.0)), 6).alias("with_unit"), F.count_if("required").alias("required"))


@query("WIN-21", """
WITH s AS (SELECT 1 AS o, r_name AS id FROM region UNION ALL SELECT 2, n_name FROM nation UNION ALL SELECT 3, c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT 4, p_brand FROM (SELECT DISTINCT p_brand FROM part)),
 g AS (SELECT DISTINCT o, id, upper(left(id, 1)) AS grp FROM s WHERE id <> '') SELECT grp, id, CAST(o AS INT) AS source, grp || '-' || lpad(CAST(row_number() OVER (PARTITION BY grp ORDER BY o, id) AS VARCHAR), 2, '0') AS code FROM g""")
def stable_codes(spark, d):
    """Codes GROUP-nn for the entries of four fixed lists, numbered in the order of the lists and then of the entries."""
    lists = [("region", "r_name"), ("nation", "n_name"), ("customer", "c_mktsegment"), ("part", "p_brand")]
    s = None
    for k, (name, column) in enumerate(lists, 1):
        x = t(spark, d, name).select(F.lit(k).alias("source"), F.col(column).alias("id")).distinct()
        s = x if s is None else s.unionByName(x)
    s = s.where("id <> ''").withColumn("grp", F.upper(F.substring("id", 1, 1)))
    no = F.row_number().over(W.partitionBy("grp").orderBy("source", "id"))  # over the few names
    return s.withColumn("no", no).select("grp", "id", "source", F.concat("grp", F.lit("-"), F.when(F.col("no") < 100, F.lpad(F.col("no").cast("string"), 2, "0")).otherwise(F.col("no").cast("string"))).alias("code"))


CHECKLIST = ("C2", "C0", "C4")


@query("ORD-1", f"""
WITH {FIND}, k AS (SELECT ord, scope_key, least(coalesce(list_position({list(CHECKLIST)}, code), 4), coalesce(list_position({list(CHECKLIST)}, 'C' || round), 4)) AS place FROM f)
SELECT ord, CAST(place AS INT) AS place, CAST(row_number() OVER (ORDER BY place, scope_key, ord) AS BIGINT) AS line FROM k""")
def checklist_order(spark, d):
    """The line of each finding in a report ordered by the checklist: by the first code of the list that it names, unknown
    ones last, then by scope and id. Lines come from a global sort, not from one task."""
    known = F.array(*map(F.lit, CHECKLIST))
    at = lambda c: F.when(F.array_position(known, c) > 0, F.array_position(known, c)).otherwise(len(CHECKLIST) + 1)
    f = findings(spark, d).select("ord", "scope_key", F.least(at(F.col("code")), at(F.concat(F.lit("C"), F.col("round").cast("string")))).cast("int").alias("place"))
    r = rank_in_key(f.withColumn("all", F.lit(1)), ["all"], ["place", "scope_key", "ord"])
    return r.select("ord", "place", F.col("rank").alias("line"))


@query("ORD-13", """
SELECT doc_id, name, arg_min(number_id, (CASE WHEN trim(don_vi) <> '' THEN 0 ELSE 1 END, CASE WHEN page IS NULL THEN 1 ELSE 0 END, coalesce(page, 0), number_id)) AS number_id FROM so_lieu_anh WHERE doc_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2""")
def best_evidence(spark, d):
    """For each parameter of a document the number read from an image that speaks best for it: with a unit before without,
    with a page before without, earlier pages first."""
    s = t(spark, d, "so_lieu_anh").where("doc_id is not null and name is not null")
    score = F.struct(F.when(F.trim("don_vi") != "", 0).otherwise(1).alias("u"), F.when(F.col("page").isNull(), 1).otherwise(0).alias("p"), F.coalesce("page", F.lit(0)).alias("at"), "number_id")
    return s.groupBy("doc_id", "name").agg(F.min(score)["number_id"].alias("number_id"))


@query("ORD-15", """
WITH r AS (SELECT DISTINCT project_id, id, max(created_at) OVER (PARTITION BY id) AS made FROM project_revisions WHERE project_id IS NOT NULL AND id IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY made DESC NULLS LAST, id) AS k FROM r)
SELECT project_id, CAST(k AS INT) AS k, id FROM k WHERE k <= 5""")
def newest_revisions(spark, d):
    """The five newest revisions of each project, newest first; a row number with a limit keeps five a project and task."""
    r = t(spark, d, "project_revisions").where("project_id is not null and id is not null")
    r = r.select("project_id", "id").distinct().join(r.groupBy("id").agg(F.max("created_at").alias("at")), "id")
    k = F.row_number().over(W.partitionBy("project_id").orderBy(F.col("at").desc_nulls_last(), "id"))
    return r.withColumn("k", k).where("k <= 5").select("project_id", "k", "id")


@query("FUN-J4", """
WITH r AS (SELECT DISTINCT id, snapshot_content AS s FROM project_revisions)
SELECT CASE WHEN s IS NULL THEN 'no content' WHEN NOT json_valid(s) THEN 'broken' WHEN json_type(s) <> 'OBJECT' THEN 'no object' WHEN json_type(s, '$.dinhCoHeThongContent') IS NULL THEN 'absent' WHEN json_type(s, '$.dinhCoHeThongContent') = 'NULL' THEN 'null' ELSE 'there' END AS state, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def field_presence(spark, d):
    """Whether a field is absent, null or there: three things that a plain path look-up does not tell apart."""
    r = t(spark, d, "project_revisions").select("id", F.col("snapshot_content").alias("s")).distinct().withColumn("v", F.try_parse_json("s"))
    field = F.try_variant_get("v", "$.dinhCoHeThongContent", "variant")
    state = (F.when(F.col("s").isNull(), "no content").when(F.col("v").isNull(), "broken").when(~F.schema_of_variant("v").startswith("OBJECT"), "no object")
             .when(field.isNull(), "absent").when(F.is_variant_null(field), "null").otherwise("there"))
    return r.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("RUL-21", """
WITH g AS (SELECT DISTINCT value_id, gia_tri_nguyen_van AS x FROM gia_tri_so WHERE gia_tri_nguyen_van IS NOT NULL)
SELECT value_id, CASE WHEN regexp_matches(x, '(?i)(giao dịch|gd|req)\\s*/|tp[smh]$') THEN 'rate' WHEN regexp_matches(x, '[kKMGT]i?[bB](it)?(ps|/s)') THEN 'bandwidth' WHEN regexp_matches(x, '[KMGTkmgt]i?[bB](yte)?s?$') THEN 'storage' WHEN regexp_matches(x, '(?i)(giờ|gio|phút|phut|giây|giay|hours?|min|days?|[0-9 ][hs])$') THEN 'time' WHEN regexp_matches(x, '%$') THEN 'share' ELSE '' END AS quantity,
 CASE WHEN regexp_matches(x, '[0-9]\\s*M') THEN 'mega' WHEN regexp_matches(x, '[0-9]\\s*m') THEN 'milli or minute' WHEN regexp_matches(x, '[0-9]\\s*[Kk]') THEN 'kilo' WHEN regexp_matches(x, '[0-9]\\s*G') THEN 'giga' ELSE '' END AS suffix FROM g""")
def quantity_kinds(spark, d):
    """What kind of quantity an entry is, by ordered signs, and its suffix, where capital and small letters differ."""
    x = F.col("x")
    q = (F.when(x.rlike(r"(?iu)(giao dịch|gd|req)\s*/|tp[smh]$"), "rate").when(x.rlike(r"[kKMGT]i?[bB](it)?(ps|/s)"), "bandwidth").when(x.rlike(r"[KMGTkmgt]i?[bB](yte)?s?$"), "storage")
         .when(x.rlike(r"(?iu)(giờ|gio|phút|phut|giây|giay|hours?|min|days?|[0-9 ][hs])$"), "time").when(x.rlike("%$"), "share").otherwise(""))
    s = F.when(x.rlike(r"[0-9]\s*M"), "mega").when(x.rlike(r"[0-9]\s*m"), "milli or minute").when(x.rlike(r"[0-9]\s*[Kk]"), "kilo").when(x.rlike(r"[0-9]\s*G"), "giga").otherwise("")
    return t(spark, d, "gia_tri_so").where("gia_tri_nguyen_van is not null").select("value_id", F.col("gia_tri_nguyen_van").alias("x")).distinct().select("value_id", q.alias("quantity"), s.alias("suffix"))


@query("SRC-9 SRC-10", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN left(props, length(props) - 1) WHEN event_id % 10 = 1 THEN '{"k": "many"}' ELSE props END AS answer FROM events)
SELECT event_id, CASE WHEN json_valid(answer) THEN try_cast(answer->>'$.k' AS INT) END AS k, CASE WHEN answer IS NULL THEN 'none' WHEN NOT json_valid(answer) THEN 'broken' WHEN try_cast(answer->>'$.k' AS INT) IS NULL THEN 'wrong type' ELSE 'good' END AS state FROM x""")
def recorded_answers(spark, d):
    """Recorded answers of a service under a schema: what is broken or of a wrong type is told apart and kept. Every tenth
    answer is broken off and every tenth has a word for a number, so that there is something to tell."""
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).when(F.col("event_id") % 10 == 1, F.lit('{"k": "many"}')).otherwise(F.col("props")).alias("answer"))
    e = e.withColumns({"v": F.try_parse_json("answer")}).withColumn("k", F.try_variant_get("v", "$.k", "int"))
    return e.select("event_id", "k", F.when(F.col("answer").isNull(), "none").when(F.col("v").isNull(), "broken").when(F.col("k").isNull(), "wrong type").otherwise("good").alias("state"))


@query("SRC-21", """
SELECT o_orderkey, sha2 AS signature FROM (SELECT o_orderkey, sha256('v2|' || o_orderpriority) AS sha2 FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND sha256('v' || CAST(1 + l_linenumber % 2 AS VARCHAR) || '|' || '1-URGENT') = o.sha2)""")
def resumed_by_signature(spark, d):
    """What a resumed run has to do: results count as done only under the signature of the settings that made them."""
    sig = lambda *c: F.sha2(F.encode(F.concat(*c), "UTF-8"), 256)
    o = t(spark, d, "orders").select("o_orderkey", sig(F.lit("v2|"), "o_orderpriority").alias("signature"))
    done = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), sig(F.lit("v"), (1 + F.col("l_linenumber") % 2).cast("string"), F.lit("|1-URGENT")).alias("signature"))
    return o.join(done, ["o_orderkey", "signature"], "left_anti").select("o_orderkey", "signature")
