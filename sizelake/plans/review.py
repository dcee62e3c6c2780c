"""Rules over entities, the report pipeline on findings, recall against labels, parameters and their conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sizelake.functions import numbers as N
from sizelake.functions import text as X
from sizelake.operators.matching import best_by_words
from sizelake.plans.registry import query
from sizelake.rules.evaluate import STORAGE, SUBSYSTEM, SYSTEM, Input, Rule, evaluate, scope_instances
from sizelake.sources.tables import table as t

RULES = [
    Rule("CAP-01", SYSTEM, "critical", check="total_orders >= 1000 and total_orders <= limit_orders", inputs=(Input("total_orders"), Input("limit_orders"))),
    Rule("CAP-02", SUBSYSTEM, "major", check="max_price <= price_limit * 0.9", inputs=(Input("max_price"), Input("price_limit"))),
    Rule("CAP-03", STORAGE, "minor", check="avg_qty < 26 or max_discount <= discount_limit", inputs=(Input("avg_qty"), Input("max_discount"), Input("discount_limit"))),
    Rule("CAP-04", SUBSYSTEM, "major", formula="sum_price / n_orders", compare_with="declared_avg", tolerance=0.01, inputs=(Input("sum_price"), Input("n_orders"))),
    Rule("CAP-05", SUBSYSTEM, "major", check="max_price > 0", applies_when="segment == 'BUILDING'", inputs=(Input("max_price"), Input("segment"))),
]


def entity_params(spark, d):
    """(subsystems, params): customers as subsystems, their return flags as storage, everything in one document."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    li = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    per = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("max_price"), F.round(F.sum("o_totalprice"), 2).alias("sum_price"), F.count("*").cast("double").alias("n_orders"))
    # declared averages: every seventh customer states one that is too high
    per = per.withColumn("declared_avg", F.round(F.col("sum_price") / F.col("n_orders"), 2) * F.when(F.col("o_custkey") % 7 == 0, 1.05).otherwise(1.0))
    stored = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_returnflag").agg(F.avg("l_quantity").alias("avg_qty"), F.max("l_discount").alias("max_discount"))
    doc = F.lit("all").alias("doc_id")
    num = lambda k, name, v: F.struct(k.alias("scope_key"), F.lit(name).alias("name"), F.lit("num").alias("kind"), v.cast("double").alias("num"), F.lit(None).cast("string").alias("str"))
    key = F.col("o_custkey").cast("string")
    a = per.select(F.explode(F.array(*[num(key, x, F.col(x)) for x in ("max_price", "sum_price", "n_orders", "declared_avg")])).alias("p"))
    skey = F.concat(key, F.lit("/"), "l_returnflag")
    b = stored.select(F.explode(F.array(*[num(skey, x, F.col(x)) for x in ("avg_qty", "max_discount")])).alias("p"))
    s = c.select(F.struct(F.col("c_custkey").cast("string").alias("scope_key"), F.lit("segment").alias("name"), F.lit("str").alias("kind"), F.lit(None).cast("double").alias("num"), F.col("c_mktsegment").alias("str")).alias("p"))
    g = o.agg(F.count("*").cast("double").alias("total_orders")).select(F.explode(F.array(num(F.lit(""), "total_orders", F.col("total_orders")), num(F.lit(""), "limit_orders", F.lit(1e9)), num(F.lit(""), "price_limit", F.lit(400000.0)), num(F.lit(""), "discount_limit", F.lit(0.08)))).alias("p"))
    p = a.unionByName(b).unionByName(s).unionByName(g).select(doc, "p.*").withColumns({"bool": F.lit(None).cast("boolean"), "ambiguous": F.lit(False)})
    subs = c.select(doc, F.col("c_custkey").cast("string").alias("name"), F.lit("").alias("storage")).unionByName(stored.select(doc, key.alias("name"), F.col("l_returnflag").alias("storage")))
    return subs, p


RULE_SQL = """
WITH per AS (SELECT o_custkey AS k, max(o_totalprice) AS max_price, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders GROUP BY 1),
 st AS (SELECT o_custkey AS k, l_returnflag AS f, avg(l_quantity) AS q, max(l_discount) AS disc FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 x AS (
 SELECT 'CAP-01' AS rule_id, CASE WHEN count(*) >= 1000 AND count(*) <= 1e9 THEN 'pass' ELSE 'violation' END AS status, 'critical' AS sev, 'over_threshold' AS bad FROM orders
 UNION ALL SELECT 'CAP-02', CASE WHEN p.k IS NULL THEN 'missing' WHEN max_price <= 400000.0 * 0.9 THEN 'pass' ELSE 'violation' END, 'major', 'over_threshold' FROM customer c LEFT JOIN per p ON p.k = c.c_custkey
 UNION ALL SELECT 'CAP-03', CASE WHEN q < 26 OR disc <= 0.08 THEN 'pass' ELSE 'violation' END, 'minor', 'over_threshold' FROM st
 UNION ALL SELECT 'CAP-04', CASE WHEN p.k IS NULL THEN 'missing' WHEN abs(s / n - round(s / n, 2) * CASE WHEN p.k % 7 = 0 THEN 1.05 ELSE 1.0 END) / abs(s / n) <= 0.01 THEN 'pass' ELSE 'violation' END, 'major', 'wrong_formula' FROM customer c LEFT JOIN per p ON p.k = c.c_custkey
 UNION ALL SELECT 'CAP-05', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'not_applicable' WHEN p.k IS NULL THEN 'missing' WHEN max_price > 0 THEN 'pass' ELSE 'violation' END, 'major', 'over_threshold' FROM customer c LEFT JOIN per p ON p.k = c.c_custkey)
SELECT rule_id, CASE status WHEN 'missing' THEN 'not_evaluable' ELSE status END AS status, CASE status WHEN 'missing' THEN 'minor' WHEN 'pass' THEN 'info' ELSE sev END AS severity,
  CASE status WHEN 'missing' THEN 'missing_info' WHEN 'pass' THEN 'pass_with_evidence' WHEN 'violation' THEN bad END AS category, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL"""


@query("RUL-1 RUL-2 RUL-3 RUL-5 RUL-6 JOIN-1 JOIN-2 JOIN-3 AGG-5 AGG-33", RULE_SQL)
def rule_outcomes(spark, d):
    """Threshold and formula rules over every entity; each instance has one status."""
    out = evaluate(RULES, *entity_params(spark, d))
    sev = F.when(F.col("status") == "not_applicable", "major").otherwise(F.col("severity"))
    return out.groupBy("rule_id", "status", sev.alias("severity"), "category").agg(F.count("*").alias("n"))


@query("JOIN-1 AGG-33", """
SELECT n_name AS doc_id, r.rule_id, CASE WHEN r.scope = 'system' THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS scope_key
FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (VALUES ('A-1', 'system'), ('A-2', 'subsystem')) r(rule_id, scope) GROUP BY ALL""")
def scope_expand_rules(spark, d):
    s = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("doc_id"), F.col("c_custkey").cast("string").alias("name"), F.lit(None).cast("string").alias("storage"))
    return scope_instances([Rule("A-1", SYSTEM, check="1 == 1"), Rule("A-2", SUBSYSTEM, check="1 == 1")], s)


# ---- findings ----
FIND = """f AS (SELECT DISTINCT nhan_xet_id AS ord, doc_id, rule_id AS rule_ref, coalesce(scope_key, '') AS scope_key, ly_do AS finding, coalesce(trich_dan_tai_lieu, '') AS evidence,
  CASE ket_luan WHEN 'khong_dat' THEN 'missing_info' WHEN 'dat' THEN 'pass_with_evidence' ELSE 'unverifiable' END AS category,
  CASE WHEN CAST(right(rule_id, 2) AS INT) % 3 = 0 THEN 1 WHEN CAST(right(rule_id, 2) AS INT) % 3 = 1 THEN 2 ELSE 0 END AS round, 'C' || (CAST(right(rule_id, 2) AS INT) % 5) AS code,
  CASE CAST(right(rule_id, 2) AS INT) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'other' END AS severity
 FROM nhan_xet_dinh_tinh WHERE regexp_matches(rule_id, '[0-9]{2}$'))"""


def findings(spark, d):
    num = F.right("rule_id", F.lit(2)).cast("int")
    n = t(spark, d, "nhan_xet_dinh_tinh").where(F.col("rule_id").rlike("[0-9]{2}$"))
    return n.select(
        F.col("nhan_xet_id").alias("ord"), "doc_id", F.col("rule_id").alias("rule_ref"), F.coalesce("scope_key", F.lit("")).alias("scope_key"), F.col("ly_do").alias("finding"),
        F.coalesce("trich_dan_tai_lieu", F.lit("")).alias("evidence"),
        F.when(F.col("ket_luan") == "khong_dat", "missing_info").when(F.col("ket_luan") == "dat", "pass_with_evidence").otherwise("unverifiable").alias("category"),
        F.when(num % 3 == 0, 1).when(num % 3 == 1, 2).otherwise(0).alias("round"), F.concat(F.lit("C"), (num % 5).cast("string")).alias("code"),
        F.when(num % 4 == 0, "critical").when(num % 4 == 1, "major").when(num % 4 == 2, "minor").otherwise("other").alias("severity")).distinct()


def deduplicated(f):
    """The first of equal findings, by ord, with how many there were. A reduce, not a window."""
    key = ["doc_id", "rule_ref", "scope_key", "category", "finding"]
    rest = [c for c in f.columns if c not in (*key, "ord")]
    g = f.groupBy(*key).agg(F.min(F.struct("ord", *rest)).alias("x"), F.count("*").alias("merged"))
    return g.select(*key, "x.*", "merged")


def gated(f):
    """f with blocked: a round-2 finding whose code failed in round 1 in a scope that covers its own. The failed scopes of a
    (document, code) are looked up by the ancestors of a scope, so that the join has equal keys only."""
    failed = f.where((F.col("round") == 1) & F.col("category").isin("missing_info", "missing_section")).select("doc_id", "code", F.col("scope_key").alias("covering")).distinct()
    second = f.where("round = 2")
    parts = F.split("scope_key", "/")
    ancestors = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    hit = second.select("doc_id", "code", "scope_key", "ord", F.explode(ancestors).alias("covering")).join(failed, ["doc_id", "code", "covering"], "left_semi").select("ord").distinct().withColumn("blocked", F.lit(True))
    return f.join(hit, "ord", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


GATE = """kept AS (SELECT * FROM f WHERE evidence <> ''), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_ref, scope_key, category, finding ORDER BY ord) AS r FROM kept) WHERE r = 1),
 g AS (SELECT k.*, round = 2 AND EXISTS (SELECT 1 FROM k b WHERE b.round = 1 AND b.category = 'missing_info' AND b.doc_id = k.doc_id AND b.code = k.code AND (b.scope_key = '' OR b.scope_key = k.scope_key OR starts_with(k.scope_key, b.scope_key || '/'))) AS blocked FROM k)"""


@query("FLT-6 AGG-18", f"""
WITH {FIND} SELECT doc_id, rule_ref, scope_key, category, finding, min(ord) AS ord, CAST(count(*) AS BIGINT) AS merged FROM f WHERE evidence <> '' GROUP BY 1, 2, 3, 4, 5""")
def findings_deduplicated(spark, d):
    return deduplicated(findings(spark, d).where("evidence <> ''")).select("doc_id", "rule_ref", "scope_key", "category", "finding", "ord", "merged")


@query("JOIN-4 AGG-19", f"WITH {FIND}, {GATE} SELECT ord, blocked FROM g WHERE round = 2")
def gate_round2(spark, d):
    return gated(deduplicated(findings(spark, d).where("evidence <> ''"))).where("round = 2").select("ord", "blocked")


@query("RUL-14 ORD-2 SET-1", f"""
WITH {FIND}, {GATE} SELECT CASE WHEN round = 1 THEN 'round1' WHEN round <> 2 THEN 'other' WHEN blocked THEN 'held' WHEN category = 'missing_info' THEN 'failed' ELSE 'unchecked' END AS bucket,
  CAST(coalesce(list_position(['critical', 'major', 'minor'], severity), 4) AS INT) AS rank, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1, 2
 UNION ALL SELECT 'dropped', 0, CAST(count(*) AS BIGINT) FROM f WHERE evidence = ''""")
def report_pipeline(spark, d):
    """Evidence gate, dedup, round-2 gate, buckets by severity; what the evidence gate drops is counted."""
    f = findings(spark, d)
    g = gated(deduplicated(f.where("evidence <> ''")))
    bucket = F.when(F.col("round") == 1, "round1").when(F.col("round") != 2, "other").when(F.col("blocked"), "held").when(F.col("category") == "missing_info", "failed").otherwise("unchecked")
    order = F.array(*map(F.lit, ("critical", "major", "minor")))
    rank = F.when(F.array_contains(order, F.col("severity")), F.array_position(order, F.col("severity"))).otherwise(4).cast("int")
    out = g.groupBy(bucket.alias("bucket"), rank.alias("rank")).agg(F.count("*").alias("n"))
    return out.unionByName(f.where("evidence = ''").agg(F.count("*").alias("n")).select(F.lit("dropped").alias("bucket"), F.lit(0).alias("rank"), "n"))


@query("AGG-6 ORD-4", f"""
WITH {FIND} SELECT rule_ref, category, finding, severity, min(ord) AS first_ord, list_slice(list(scope_key ORDER BY ord) FILTER (WHERE scope_key <> ''), 1, 12) AS scopes, CAST(count(*) AS BIGINT) AS n
FROM f WHERE finding IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE scope_key <> '') > 0""")
def group_same_issue(spark, d):
    """One issue over many scopes said once: the first finding, the first twelve scopes in order, the count. The twelve are
    cut by rank within the issue before they are collected."""
    f = findings(spark, d).where("finding is not null")
    key = ["rule_ref", "category", "finding", "severity"]
    n = f.groupBy(*key).agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))
    top = f.where("scope_key <> ''").withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("ord"))).where("k <= 12")
    s = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "scope_key"))).alias("s")).select(*key, F.col("s.scope_key").alias("scopes"))
    return n.join(s, key).select(*key, "first_ord", "scopes", "n")


@query("AGG-7 AGG-8", f"""
WITH {FIND}, m AS (SELECT rule_ref, doc_id, scope_key, unnest(regexp_extract_all(lower(finding), '(hiện là [0-9]+|mức sử dụng [0-9]+%)', 1)) AS missing FROM f WHERE finding IS NOT NULL)
SELECT regexp_replace(missing, '[0-9]+', '#') AS what, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT rule_ref) AS BIGINT) AS rules, CAST(count(DISTINCT scope_key) AS BIGINT) AS scopes, CAST(count(DISTINCT doc_id) AS BIGINT) AS places,
  CAST(sum(CAST(regexp_extract(missing, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total FROM m GROUP BY 1""")
def group_by_template(spark, d):
    """Findings by the template they fill: counts, distinct rules and scopes, and the sum of the numbers filled in."""
    f = findings(spark, d).where("finding is not null")
    m = f.select("rule_ref", "doc_id", "scope_key", F.explode(F.regexp_extract_all(F.lower("finding"), F.lit("(hiện là [0-9]+|mức sử dụng [0-9]+%)"), 1)).alias("missing"))
    return m.groupBy(F.regexp_replace("missing", "[0-9]+", "#").alias("what")).agg(
        F.count("*").alias("n"), F.countDistinct("rule_ref").alias("rules"), F.countDistinct("scope_key").alias("scopes"), F.countDistinct("doc_id").alias("places"), F.sum(F.regexp_extract("missing", "([0-9]+)", 1).cast("long")).alias("total"))


@query("WIN-15 SNK-2", f"""
WITH {FIND} SELECT ord, rule_ref || '#' || scope_key || CASE WHEN r > 1 THEN '#' || r ELSE '' END AS id FROM (SELECT ord, rule_ref, scope_key, row_number() OVER (PARTITION BY rule_ref, scope_key ORDER BY ord, doc_id, finding, evidence, category) AS r FROM f) WHERE scope_key <> ''""")
def dup_suffix(spark, d):
    """Ids made unique by an ordinal behind the second and later."""
    f = findings(spark, d).where("scope_key <> ''")
    r = F.row_number().over(W.partitionBy("rule_ref", "scope_key").orderBy("ord", "doc_id", "finding", "evidence", "category"))
    f = f.withColumn("r", r)
    return f.select("ord", F.concat("rule_ref", F.lit("#"), "scope_key", F.when(F.col("r") > 1, F.concat(F.lit("#"), F.col("r").cast("string"))).otherwise("")).alias("id"))


@query("AGG-38 AGG-3", f"""
WITH {FIND} SELECT category, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share, round(sum(sum(CASE WHEN category = 'unverifiable' THEN 1 ELSE 0 END)) OVER () * 1.0 / sum(count(*)) OVER (), 6) AS noise FROM f GROUP BY 1""")
def noise_share(spark, d):
    c = findings(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    w = W.partitionBy()
    total = F.sum("n").over(w)
    return c.select("category", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(F.sum(F.when(F.col("category") == "unverifiable", F.col("n")).otherwise(0)).over(w) / total, 6).alias("noise"))


# ---- labels ----
LABEL = "l AS (SELECT item_id AS label_id, 'HS-00-' || lpad(CAST(item_id % 16 AS VARCHAR), 6, '0') AS dossier, vong AS round, category, ['DT-' || lpad(CAST(item_id % 30 + 1 AS VARCHAR), 2, '0'), 'DT-' || lpad(CAST(item_id * 7 % 30 + 1 AS VARCHAR), 2, '0')] AS refs, text FROM eval_items)"


def labels(spark, d):
    """Items as labels. The tables name neither code nor dossier of an item; both are laid out from its number, in the form
    that findings have, over the dossiers 0 to 15 of the smallest tables."""
    code = lambda x: F.concat(F.lit("DT-"), F.lpad((x % 30 + 1).cast("string"), 2, "0"))
    dossier = F.concat(F.lit("HS-00-"), F.lpad((F.col("item_id") % 16).cast("string"), 6, "0"))
    i = t(spark, d, "eval_items")
    return i.select(F.col("item_id").alias("label_id"), dossier.alias("dossier"), F.col("vong").alias("round"), "category", F.array(code(F.col("item_id")), code(F.col("item_id") * 7)).alias("refs"), "text")


def label_hits(labels, findings):
    """(label_id, category, hit, hard) of each label: a finding of the same dossier has one of its codes; passes are none."""
    f = findings.where(F.col("category") != "pass_with_evidence")
    c = f.groupBy(F.col("doc_id").alias("dossier"), F.col("rule_ref").alias("ref")).agg(F.bool_or(F.col("category") == "missing_info").alias("hard"))
    refs = labels.select("label_id", "dossier", "category", F.explode_outer("refs").alias("ref"))
    return refs.join(c, ["dossier", "ref"], "left").groupBy("label_id", "category").agg(F.bool_or(F.col("hard").isNotNull()).alias("hit"), F.coalesce(F.bool_or("hard"), F.lit(False)).alias("hard"))


@query("JOIN-10 AGG-10 AGG-11 RUL-19 SET-3", f"""
WITH {LABEL}, {FIND}, c AS (SELECT doc_id, rule_ref, bool_or(category = 'missing_info') AS hard FROM f WHERE category <> 'pass_with_evidence' GROUP BY 1, 2),
 h AS (SELECT l.label_id, l.category, bool_or(c.rule_ref IS NOT NULL) AS hit, coalesce(bool_or(c.hard), false) AS hard FROM (SELECT label_id, category, dossier, unnest(refs) AS ref FROM l) l LEFT JOIN c ON c.rule_ref = l.ref AND c.doc_id = l.dossier GROUP BY 1, 2)
SELECT coalesce(category, 'all') AS category, CAST(count(*) AS BIGINT) AS labels, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN hard THEN 1.0 ELSE 0.0 END), 6) AS substantive
FROM h GROUP BY ROLLUP (category)""")
def label_hit_recall(spark, d):
    """Recall of labels by class: a label counts once however many codes match, misses stay in the denominator, passes are
    no hits; substantive hits need a finding of a hard class."""
    h = label_hits(labels(spark, d), findings(spark, d))
    one = lambda x: F.round(F.avg(F.when(F.col(x), 1.0).otherwise(0.0)), 6)
    return h.rollup("category").agg(F.count("*").alias("labels"), F.count_if("hit").alias("hits"), one("hit").alias("recall"), one("hard").alias("substantive")).select(F.coalesce("category", F.lit("all")).alias("category"), "labels", "hits", "recall", "substantive")


@query("RUL-18 RUL-23 FLT-25 JOIN-24", """
WITH x AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN contains(s, 'phê duyệt') THEN 'procedure' WHEN contains(s, 'bổ sung') OR contains(s, 'thiếu') OR contains(s, 'chưa nêu') THEN 'missing'
  WHEN len(string_split(s, ' ')) <= 5 THEN 'fragment' WHEN contains(s, 'kiểm tra lại') OR contains(s, 'trình bày') THEN 'order' ELSE 'other' END AS kind FROM x""")
def label_typing(spark, d):
    """The kind of a remark by ordered lists of words; very short ones are fragments."""
    s = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    has = lambda *w: reduce(lambda a, b: a | b, [F.contains(s, F.lit(x)) for x in w])
    kind = (F.when(has("phê duyệt"), "procedure").when(has("bổ sung", "thiếu", "chưa nêu"), "missing").when(F.size(F.split(s, " ")) <= 5, "fragment")
            .when(has("kiểm tra lại", "trình bày"), "order").otherwise("other"))
    return t(spark, d, "documents").where("text is not null").select("doc_id", kind.alias("kind"))


@query("JOIN-7 AGG-27", """
WITH r AS (SELECT DISTINCT source, vong FROM documents WHERE vong IS NOT NULL AND source IS NOT NULL), k AS (SELECT source, CAST(unnest([1, 2, 3]) AS INT) AS n FROM (SELECT DISTINCT source FROM r))
SELECT k.source, k.n, CAST(coalesce(max(r.vong) FILTER (WHERE r.vong <= k.n), min(r.vong)) AS INT) AS used FROM k JOIN r USING (source) GROUP BY 1, 2""")
def asof_nearest_round(spark, d):
    """The round used for round n: itself, else the latest before, else the earliest. The rounds of a source are a small set."""
    r = t(spark, d, "documents").where("vong is not null and source is not null").groupBy("source").agg(F.collect_set("vong").alias("v"))
    r = r.select("source", "v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    return r.select("source", "n", F.coalesce(F.array_max(F.filter("v", lambda x: x <= F.col("n"))), F.array_min("v")).alias("used"))


@query("JOIN-25 JOIN-30 SET-2 SET-12", """
WITH m AS (SELECT item_id, CASE WHEN item_id % 11 = 0 THEN 'manual' WHEN item_id % 4 = 0 THEN 'audit' ELSE 'machine' END AS source FROM eval_items), o AS (SELECT item_id, 'v' || item_id % 3 AS v FROM eval_items WHERE item_id % 11 = 0 UNION ALL SELECT 100000, 'stray'),
 a AS (SELECT item_id, 'a' || item_id % 5 AS v FROM eval_items WHERE item_id % 4 = 0)
SELECT coalesce(i.item_id, o.item_id) AS item_id, coalesce(o.v, a.v, i.category) AS verdict, CASE WHEN i.item_id IS NULL THEN 'stray' WHEN o.v IS NOT NULL THEN 'manual' WHEN a.v IS NOT NULL THEN 'audit' ELSE 'machine' END AS from_source
FROM eval_items i LEFT JOIN a ON a.item_id = i.item_id FULL JOIN o ON o.item_id = i.item_id""")
def precedence_merge(spark, d):
    """Manual before audit before machine, with where each verdict comes from; overrides of unknown items are reported."""
    i = t(spark, d, "eval_items").select("item_id", "category")
    o = i.where("item_id % 11 = 0").select("item_id", F.concat(F.lit("v"), (F.col("item_id") % 3).cast("string")).alias("o")).unionByName(spark.createDataFrame([(100000, "stray")], "item_id bigint, o string"))
    a = i.where("item_id % 4 = 0").select("item_id", F.concat(F.lit("a"), (F.col("item_id") % 5).cast("string")).alias("a"))
    j = i.withColumn("known", F.lit(True)).join(a, "item_id", "left").join(o, "item_id", "full_outer")
    src = F.when(F.col("known").isNull(), "stray").when(F.col("o").isNotNull(), "manual").when(F.col("a").isNotNull(), "audit").otherwise("machine")
    return j.select("item_id", F.coalesce("o", "a", "category").alias("verdict"), src.alias("from_source"))


# fixed values: words that say nothing of what a text is about; signs of a text that may be a label; weights by kind of place
FILLERS = ("của", "và", "các", "cho", "hay", "là", "có", "được", "theo", "từ", "đến", "trong", "với", "về", "những", "một", "nếu", "thì", "không", "gồm", "tại", "hoặc", "khi", "đối", "này", "đó", "như", "thế", "nào", "phải", "cần", "sẽ", "bao", "chỉ", "ra", "mà", "để", "trên", "dưới", "sau", "trước", "còn", "đã", "bị", "do", "vào", "nên")  # noqa: E501
MOST_LABEL, HEAD_WORDS = 90, 5
PLACES = {"heading": 1.0, "label": 0.95, "cell": 0.9, "prose": 0.8}
_LIST = "(" + ", ".join(f"'{w}'" for w in FILLERS) + ")"


def _kept(text: str) -> str:
    return f"list_filter(regexp_split_to_array(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN {_LIST})"


def _f1(a: str, b: str) -> str:
    return f"(2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})))"


@query("JOIN-13 FUN-S14 ORD-6", f"""
WITH i AS (SELECT item_id, {_kept("regexp_replace(text, '[(][^)]*[)]', ' ', 'g')")} AS l FROM eval_items), w AS (SELECT item_id, list_distinct(l) AS w, list_distinct(l[1:{HEAD_WORDS}]) AS h, list_distinct(list_transform(l, lambda x: translate(strip_accents(x), 'đ', 'd'))) AS p FROM i WHERE len(l) > 0),
 c AS (SELECT DISTINCT text, CASE WHEN kind = 'heading' THEN 1.0 WHEN kind = 'paragraph' AND length(text) <= {MOST_LABEL} AND NOT ends_with(rtrim(text), '.') THEN 0.95 ELSE 0.8 END AS weight FROM elements WHERE text <> ''
  UNION SELECT DISTINCT trim(cell), 0.9 FROM (SELECT unnest(flatten(list_transform(rows, lambda r: r[1:2]))) AS cell FROM elements WHERE kind = 'table') WHERE trim(cell) <> '' AND length(trim(cell)) <= {MOST_LABEL} AND NOT regexp_full_match(replace(trim(cell), '.', ''), '[0-9]+')),
 t AS (SELECT text, weight, list_distinct({_kept("text")}) AS w FROM c), d AS (SELECT *, list_distinct(list_transform(w, lambda x: translate(strip_accents(x), 'đ', 'd'))) AS p FROM t WHERE len(w) > 0),
 s AS (SELECT item_id, text, weight, len(list_intersect(w.w, d.w)) AS kw, len(list_intersect(w.h, d.w)) AS kh, len(list_intersect(w.p, d.p)) AS kp, {_f1("w.w", "d.w")} AS fw, {_f1("w.h", "d.w")} AS fh, {_f1("w.p", "d.p")} AS fp FROM w JOIN d ON list_has_any(w.p, d.p)),
 r AS (SELECT item_id, text, weight, CASE WHEN CASE WHEN fh > fw THEN kh ELSE kw END >= 2 THEN greatest(fh, fw) WHEN kp >= 2 THEN fp END AS f1, CASE WHEN fh > fw THEN kh ELSE kw END >= 2 AS exact FROM s)
SELECT item_id, f1, text, exact FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(f1 * weight, 6) DESC, text, f1) AS k FROM r WHERE f1 IS NOT NULL) WHERE k = 1""")
def token_f1_best(spark, d):
    """Where in the documents an item is spoken of: the heading, label, table cell or text whose words fit it best."""
    kept = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")), " "), lambda w: (F.length(w) > 1) & ~w.isin(*FILLERS))
    plain = lambda words: F.array_distinct(F.transform(words, X.strip_accents))
    i = t(spark, d, "eval_items").select(F.col("item_id").alias("item"), kept(F.regexp_replace("text", r"\([^)]*\)", " ")).alias("l"))
    i = i.select("item", F.array_distinct("l").alias("words"), F.array_distinct(F.slice("l", 1, HEAD_WORDS)).alias("head"), plain("l").alias("plain"))
    e = t(spark, d, "elements")
    label = (F.col("kind") == "paragraph") & (F.length("text") <= MOST_LABEL) & ~F.rtrim("text").endswith(".")
    weight = F.when(F.col("kind") == "heading", PLACES["heading"]).when(label, PLACES["label"]).otherwise(PLACES["prose"])
    cell = e.where("kind = 'table'").select(F.explode(F.flatten(F.transform("rows", lambda r: F.slice(r, 1, 2)))).alias("text")).select(F.trim("text").alias("text"))
    cell = cell.where((F.col("text") != "") & (F.length("text") <= MOST_LABEL) & ~F.replace("text", F.lit("."), F.lit("")).rlike("^[0-9]+$")).distinct().withColumn("weight", F.lit(PLACES["cell"]))
    c = e.where("text <> ''").select("text", weight.alias("weight")).unionByName(cell).withColumn("words", F.array_distinct(kept("text"))).withColumn("plain", plain(F.col("words")))
    b = best_by_words(c, i)
    return b.select(F.col("item").alias("item_id"), "f1", "text", "exact")


# ---- parameters ----
G = "g AS (SELECT DISTINCT value_id, doc_id, scope_key, name, gia_tri_nguyen_van AS raw, element_index FROM gia_tri_so)"


def params(spark, d):
    return t(spark, d, "gia_tri_so").select("value_id", "doc_id", "scope_key", "name", F.col("gia_tri_nguyen_van").alias("raw"), "element_index").distinct()


@query("AGG-21 FLT-17", f"""
WITH {G} SELECT value_id, CAST(count(*) OVER w AS BIGINT) AS in_cell, CAST(CASE WHEN count(*) OVER w >= 2 THEN NULL ELSE raw END AS VARCHAR) AS kept FROM g WHERE element_index IS NOT NULL WINDOW w AS (PARTITION BY doc_id, element_index, raw)""")
def one_cell_many_params(spark, d):
    """A cell that fills several parameters fills none of them."""
    g = params(spark, d).where("element_index is not null")
    n = g.groupBy("doc_id", "element_index", "raw").agg(F.count("*").alias("in_cell"))
    key = lambda x: F.coalesce(x, F.lit("\x00"))  # noqa: E731  null is a reading like any other
    g = g.withColumn("rk", key("raw")).join(n.select("doc_id", "element_index", key("raw").alias("rk"), "in_cell"), ["doc_id", "element_index", "rk"])
    return g.select("value_id", "in_cell", F.when(F.col("in_cell") < 2, F.col("raw")).alias("kept"))


@query("AGG-22", f"""
WITH {G} SELECT doc_id, scope_key, name, CAST(count(DISTINCT raw) AS BIGINT) AS readings, CASE WHEN count(DISTINCT raw) = 1 THEN min(raw) END AS value,
 CASE WHEN count(DISTINCT raw) = 0 THEN 'missing' WHEN count(DISTINCT raw) = 1 THEN 'same' ELSE 'conflict' END AS state FROM (SELECT *, CASE WHEN trim(raw) <> '' THEN raw END AS r0 FROM g) WHERE raw IS NULL OR trim(raw) <> '' GROUP BY 1, 2, 3""")
def repeated_declarations(spark, d):
    """Several declarations of one parameter: equal ones confirm, different ones leave it without a value."""
    g = params(spark, d).where("raw is null or trim(raw) <> ''")
    r = g.groupBy("doc_id", "scope_key", "name").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.countDistinct("raw").alias("readings"))
    return r.select("doc_id", "scope_key", "name", "readings", F.when(F.col("readings") == 1, F.col("lo")).alias("value"), F.when(F.col("readings") == 0, "missing").when(F.col("readings") == 1, "same").otherwise("conflict").alias("state"))


@query("JOIN-29 JOIN-16", f"""
WITH {G}, a AS (SELECT doc_id, scope_key, name, max(trim(raw)) AS v FROM g GROUP BY 1, 2, 3), b AS (SELECT doc_id, scope_key, name, max(trim(gia_tri_raw)) AS v FROM so_lieu_anh GROUP BY 1, 2, 3)
SELECT doc_id, scope_key, name, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'kept' WHEN a.v = b.v THEN 'same' ELSE 'conflict' END AS state FROM a FULL JOIN b USING (doc_id, scope_key, name)""")
def attach_without_overwrite(spark, d):
    """Values read from images are added where none stands; what stands is never overwritten."""
    a = params(spark, d).groupBy("doc_id", "scope_key", "name").agg(F.max(F.trim("raw")).alias("a"))
    b = t(spark, d, "so_lieu_anh").groupBy("doc_id", "scope_key", "name").agg(F.max(F.trim("gia_tri_raw")).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "kept").when(F.col("a") == F.col("b"), "same").otherwise("conflict")
    return a.join(b, ["doc_id", "scope_key", "name"], "full_outer").select("doc_id", "scope_key", "name", F.coalesce("a", "b").alias("value"), state.alias("state"))


@query("WIN-16", """
WITH x AS (SELECT DISTINCT rule_id, name FROM rule_inputs WHERE rule_id IS NOT NULL AND name IS NOT NULL), n AS (SELECT name, count(*) AS rules, row_number() OVER (ORDER BY name) AS r, count(*) OVER () AS total FROM x GROUP BY 1)
SELECT name, CAST(rules AS BIGINT) AS rules, CAST(floor((r - 1) / 8) + 1 AS BIGINT) AS part, CAST(ceil(total / 8.0) AS BIGINT) AS parts, 'P-' || lpad(CAST(r AS VARCHAR), 2, '0') AS code FROM n""")
def chunk_k_of_n(spark, d):
    """Parameters of the rule book in parts of eight, part k of n, with stable codes. The rule book is a fixed list."""
    x = t(spark, d, "rule_inputs").where("rule_id is not null and name is not null").select("rule_id", "name").distinct().groupBy("name").agg(F.count("*").alias("rules"))
    w = W.orderBy("name")
    x = x.withColumns({"r": F.row_number().over(w), "total": F.count("*").over(W.partitionBy())})
    return x.select("name", "rules", (F.floor((F.col("r") - 1) / 8) + 1).alias("part"), F.ceil(F.col("total") / 8.0).alias("parts"), F.concat(F.lit("P-"), F.lpad(F.col("r").cast("string"), 2, "0")).alias("code"))


@query("JOIN-27 SET-11 RUL-17", """
WITH used AS (SELECT DISTINCT name FROM gia_tri_so WHERE name IS NOT NULL), known AS (SELECT DISTINCT name FROM rule_inputs WHERE name IS NOT NULL)
SELECT name, 'unknown' AS verdict FROM used WHERE name NOT IN (SELECT name FROM known) UNION ALL SELECT name, 'unused' FROM known WHERE name NOT IN (SELECT name FROM used)
UNION ALL SELECT name, 'no unit anywhere' FROM rule_inputs GROUP BY 1 HAVING count(nullif(trim(unit), '')) = 0
 UNION ALL SELECT DISTINCT rule_id, 'bad rule id' FROM rule_inputs WHERE rule_id IS NULL OR NOT regexp_full_match(rule_id, '[A-Z]{2,3}-[0-9]{2}') UNION ALL SELECT DISTINCT name, 'name is no identifier' FROM rule_inputs WHERE NOT regexp_full_match(name, '[a-z_][a-z0-9_]*')
 UNION ALL SELECT DISTINCT name, 'default is no number' FROM rule_inputs WHERE trim(default_value) <> '' AND try_cast(replace(trim(default_value), ',', '.') AS DOUBLE) IS NULL UNION ALL SELECT DISTINCT name, 'optional without default' FROM rule_inputs WHERE NOT required AND coalesce(trim(default_value), '') = ''""")
def rule_book_lint(spark, d):
    used = t(spark, d, "gia_tri_so").where("name is not null").select("name").distinct()
    r = t(spark, d, "rule_inputs")
    known = r.where("name is not null").select("name").distinct()
    silent = r.groupBy("name").agg(F.count(F.nullif(F.trim("unit"), F.lit(""))).alias("n")).where("n = 0").select("name")
    tag = lambda x, v: x.select("name", F.lit(v).alias("verdict"))
    return tag(used.join(known, "name", "left_anti"), "unknown").unionByName(tag(known.join(used, "name", "left_anti"), "unused")).unionByName(tag(silent, "no unit anywhere")).unionByName(
        tag(r.where(F.col("rule_id").isNull() | ~F.col("rule_id").rlike("^[A-Z]{2,3}-[0-9]{2}$")).select(F.col("rule_id").alias("name")).distinct(), "bad rule id")).unionByName(
        tag(r.where(~F.col("name").rlike("^[a-z_][a-z0-9_]*$")).select("name").distinct(), "name is no identifier")).unionByName(
        tag(r.where((F.trim("default_value") != "") & F.replace(F.trim("default_value"), F.lit(","), F.lit(".")).try_cast("double").isNull()).select("name").distinct(), "default is no number")).unionByName(
        tag(r.where(~F.col("required") & (F.coalesce(F.trim("default_value"), F.lit("")) == "")).select("name").distinct(), "optional without default"))


@query("JOIN-28", """
WITH cited AS (SELECT DISTINCT doc_id, regexp_extract(location, 'Mục ([0-9.]+)', 1) AS s FROM gia_tri_so WHERE regexp_matches(location, 'Mục [0-9]')), built AS (SELECT DISTINCT doc_id, section AS s FROM elements WHERE section <> '')
SELECT c.doc_id, CAST(count(*) AS BIGINT) AS cited, CAST(count(b.s) AS BIGINT) AS found FROM cited c LEFT JOIN built b ON b.doc_id = c.doc_id AND b.s = c.s GROUP BY 1""")
def cited_sections_found(spark, d):
    """How many of the sections that values cite exist in their document."""
    c = t(spark, d, "gia_tri_so").where(F.col("location").rlike("Mục [0-9]")).select("doc_id", F.regexp_extract("location", "Mục ([0-9.]+)", 1).alias("s")).distinct()
    b = t(spark, d, "elements").where("section <> ''").select("doc_id", F.col("section").alias("s")).distinct().withColumn("hit", F.lit(1))
    return c.join(b, ["doc_id", "s"], "left").groupBy("doc_id").agg(F.count("*").alias("cited"), F.count("hit").alias("found"))


# numbers in SQL: digits and marks of other widths as plain ones, then the reading of the first number
PLAIN = "translate({0}, '０１２３４５６７８９．，－＋％／（）' || chr(160) || chr(8194) || chr(8195) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8239) || chr(8287) || chr(12288), '0123456789.,-+%/()          ')"
FIRST_NUMBER = r"'[-+]?[0-9][0-9.,\s]*[0-9]|[0-9]'"


def number_sql(raw: str) -> tuple[str, str]:
    """(value, whether the number can be read in another way) of a number as it is written."""
    body = f"regexp_replace(replace({raw}, ' ', ''), '^[-+]+', '')"
    sign = f"CASE WHEN starts_with(replace({raw}, ' ', ''), '-') THEN -1.0 ELSE 1.0 END"
    nd, nc = (f"(length({body}) - length(replace({body}, '{m}', '')))" for m in ".,")
    two = f"({nd} + {nc} = 1 AND length(regexp_extract({body}, '[.,]([0-9]*)$', 1)) = 3 AND NOT starts_with({body}, '0'))"
    value = f"""{sign} * CASE WHEN {nd} > 0 AND {nc} > 0 THEN CASE WHEN instr(reverse({body}), '.') < instr(reverse({body}), ',') THEN try_cast(replace({body}, ',', '') AS DOUBLE) ELSE try_cast(replace(replace({body}, '.', ''), ',', '.') AS DOUBLE) END
   WHEN {nd} > 1 OR {nc} > 1 THEN try_cast(regexp_replace({body}, '[.,]', '', 'g') AS DOUBLE) WHEN {two} AND {nd} = 1 THEN try_cast(replace({body}, '.', '') AS DOUBLE) ELSE try_cast(replace({body}, ',', '.') AS DOUBLE) END"""
    return value, f"({two} OR ({nd} * {nc} = 0 AND ({nd} > 1 OR {nc} > 1) AND NOT regexp_full_match({body}, '[0-9]+([.,][0-9]{{3}})+')))"


_VALUE, _TWO = number_sql("raw")


@query("FUN-M1 FLT-9 FLT-10", f"""
WITH r AS (SELECT DISTINCT value_id, gia_tri_nguyen_van AS x, {PLAIN.format("gia_tri_nguyen_van")} AS y FROM gia_tri_so WHERE gia_tri_nguyen_van IS NOT NULL), n AS (SELECT *, regexp_extract(y, {FIRST_NUMBER}) AS raw FROM r), v AS (SELECT *, {_VALUE} AS value, {_TWO} AS two FROM n)
SELECT value_id, x, CASE WHEN raw <> '' THEN value END AS value, CASE WHEN raw <> '' AND value IS NOT NULL THEN two END AS ambiguous,
 (trim(y) <> '' AND length(trim(y)) <= 30 AND NOT regexp_full_match(trim(y), '\\s*[0-9]+\\s*[-–—]\\s*[0-9]+\\s*') AND length(regexp_extract(trim(y), '^([^0-9]*)[0-9]', 1)) <= 6 AND regexp_matches(y, '[0-9]')) AS one_value FROM v""")
def number_parse(spark, d):
    """Every raw entry read as a number: the value, whether another reading is possible, whether the entry is one value at
    all. Entries without a number have none."""
    g = t(spark, d, "gia_tri_so").where("gia_tri_nguyen_van is not null").select("value_id", F.col("gia_tri_nguyen_van").alias("x")).distinct()
    g = g.withColumn("p", N.parse_number(F.col("x")))
    return g.select("value_id", "x", "p.value", "p.ambiguous", N.looks_like_value(F.col("x")).alias("one_value"))


_EACH, _ = number_sql("n")


@query("FUN-M2 FUN-M3", f"""
WITH r AS (SELECT DISTINCT value_id, {PLAIN.format("gia_tri_nguyen_van")} AS y FROM gia_tri_so WHERE gia_tri_nguyen_van IS NOT NULL)
SELECT value_id, list_transform(regexp_extract_all(y, {FIRST_NUMBER}), lambda n: {_EACH}) AS numbers, CASE WHEN contains(y, '%') THEN (list_transform(regexp_extract_all(y, {FIRST_NUMBER}), lambda n: {_EACH}))[1] / 100 ELSE (list_transform(regexp_extract_all(y, {FIRST_NUMBER}), lambda n: {_EACH}))[1] END AS ratio FROM r""")
def numbers_and_percents(spark, d):
    """All numbers of each entry, and its first one as a ratio where a percent sign is present."""
    g = t(spark, d, "gia_tri_so").where("gia_tri_nguyen_van is not null").select("value_id", F.col("gia_tri_nguyen_van").alias("x")).distinct()
    return g.select("value_id", N.all_numbers(F.col("x")).alias("numbers"), N.parse_percent(F.col("x")).alias("ratio"))


VALUE_RULES = [
    Rule("VAL-01", SUBSYSTEM, "critical", check="tai_dinh >= tai_trung_binh * peak", inputs=(Input("tai_dinh"), Input("tai_trung_binh"))),
    Rule("VAL-02", SUBSYSTEM, "major", check="ram_moi_nut <= most_ram", applies_when="diem_cpu > 0", inputs=(Input("ram_moi_nut"), Input("diem_cpu", required=False, default=1.0))),
    Rule("VAL-03", SUBSYSTEM, "minor", formula="tai_dinh / tai_trung_binh", compare_with="declared_ratio", tolerance=0.5, inputs=(Input("tai_dinh"), Input("tai_trung_binh"))),
]
VALUE_CONSTANTS = {"peak": 1.2, "most_ram": 2048.0, "declared_ratio": 2.0}


@query("RUL-4 FUN-P1 FUN-P3", f"""
WITH g AS (SELECT DISTINCT doc_id, coalesce(scope_key, '') AS scope_key, name, {PLAIN.format("gia_tri_nguyen_van")} AS y FROM gia_tri_so WHERE doc_id IS NOT NULL AND name IN ('tai_dinh', 'tai_trung_binh', 'ram_moi_nut', 'diem_cpu')),
 n AS (SELECT *, coalesce(regexp_extract(y, {FIRST_NUMBER}), '') AS raw FROM g), v AS (SELECT doc_id, scope_key, name, CASE WHEN raw <> '' THEN {_VALUE} END AS v, raw <> '' AND {_TWO} AND {_VALUE} IS NOT NULL AS two FROM n),
 o AS (SELECT doc_id, scope_key, name, min(v) AS v, bool_or(two) AS two, count(DISTINCT v) > 1 AS many FROM v GROUP BY 1, 2, 3),
 p AS (SELECT doc_id, scope_key, name, v, two OR many AS amb FROM o WHERE v IS NOT NULL), keyed AS (SELECT DISTINCT doc_id, scope_key, name FROM o),
 s AS (SELECT DISTINCT doc_id, scope_key FROM keyed WHERE scope_key <> ''),
 x AS (SELECT s.doc_id, s.scope_key, {", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM keyed k WHERE k.doc_id = s.doc_id AND k.scope_key = s.scope_key AND k.name = '{n}') THEN (SELECT {{'v': v, 'amb': amb}} FROM p WHERE p.doc_id = s.doc_id AND p.scope_key = s.scope_key AND p.name = '{n}') ELSE (SELECT {{'v': v, 'amb': amb}} FROM p WHERE p.doc_id = s.doc_id AND p.scope_key = '' AND p.name = '{n}') END AS {a}" for n, a in (("tai_dinh", "a"), ("tai_trung_binh", "b"), ("ram_moi_nut", "c"), ("diem_cpu", "e")))} FROM s),
 r AS (SELECT 'VAL-01' AS rule_id, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a.amb OR b.amb THEN 'ambiguous' WHEN a.v >= b.v * 1.2 THEN 'pass' ELSE 'violation' END AS st FROM x
  UNION ALL SELECT 'VAL-02', CASE WHEN coalesce(e.v, 1.0) <= 0 THEN 'not_applicable' WHEN c IS NULL THEN 'missing' WHEN c.amb OR coalesce(e.amb, false) THEN 'ambiguous' WHEN c.v <= 2048 THEN 'pass' ELSE 'violation' END FROM x
  UNION ALL SELECT 'VAL-03', CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a.amb OR b.amb THEN 'ambiguous' WHEN b.v = 0 THEN 'undefined' WHEN a.v / b.v = 0 THEN 'violation' WHEN abs(a.v / b.v - 2) / abs(a.v / b.v) <= 0.5 THEN 'pass' ELSE 'violation' END FROM x)
SELECT rule_id, CASE st WHEN 'missing' THEN 'not_evaluable' WHEN 'ambiguous' THEN 'not_evaluable' WHEN 'undefined' THEN 'not_evaluable' ELSE st END AS status, CASE st WHEN 'missing' THEN 'missing_info' WHEN 'ambiguous' THEN 'unverifiable' WHEN 'pass' THEN 'pass_with_evidence' WHEN 'violation' THEN CASE rule_id WHEN 'VAL-03' THEN 'wrong_formula' ELSE 'over_threshold' END END AS category, CAST(count(*) AS BIGINT) AS n
FROM r GROUP BY ALL""")
def value_outcomes(spark, d):
    """Rules over the values as authors wrote them, with a default and constants: a number that can be read in two ways, or is
    declared in several, leaves the rule unverifiable rather than passed or failed."""
    g = t(spark, d, "gia_tri_so").where(F.col("doc_id").isNotNull() & F.col("name").isin("tai_dinh", "tai_trung_binh", "ram_moi_nut", "diem_cpu"))
    g = g.select("doc_id", F.coalesce("scope_key", F.lit("")).alias("scope_key"), "name", N.parse_number(F.col("gia_tri_nguyen_van")).alias("p"))
    g = g.groupBy("doc_id", "scope_key", "name").agg(F.min("p.value").alias("num"), F.max("p.value").alias("top"), F.bool_or("p.ambiguous").alias("two"))
    p = g.select("doc_id", "scope_key", "name", F.lit("num").alias("kind"), "num", F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"), (F.coalesce("two", F.lit(False)) | F.coalesce(F.col("num") < F.col("top"), F.lit(False))).alias("ambiguous"))
    subs = p.where("scope_key <> ''").select("doc_id", F.col("scope_key").alias("name"), F.lit("").alias("storage")).distinct()
    out = evaluate(VALUE_RULES, subs, p, VALUE_CONSTANTS)
    return out.groupBy("rule_id", "status", "category").agg(F.count("*").alias("n"))


@query("RUL-13 FUN-M16 FUN-M10", """
SELECT o_orderkey, o_totalprice / nullif(n, 0) AS per_line, CASE WHEN o_totalprice / nullif(n, 0) > 60000 THEN 'high' WHEN o_totalprice / nullif(n, 0) IS NULL THEN 'unknown' ELSE 'ok' END AS verdict
FROM (SELECT o_orderkey, o_totalprice, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def sanity_ratio(spark, d):
    """A ratio with a threshold; without a denominator it is unknown, not zero."""
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    r = F.try_divide("o_totalprice", F.nullif(F.col("n"), F.lit(0)))
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(n, "o_orderkey", "left").select("o_orderkey", r.alias("per_line"), F.when(r > 60000, "high").when(r.isNull(), "unknown").otherwise("ok").alias("verdict"))
