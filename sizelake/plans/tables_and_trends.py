"""Filters, paging, shares, trends, top lists and look-ups over flat tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sizelake.operators.matching import rank_in_key
from sizelake.plans.registry import query
from sizelake.sources.tables import table as t

NOW = "1998-09-01"


@query("AGG-2 PRJ-2", """
SELECT coalesce(o_orderstatus, 'TOTAL') AS status, CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 100.0 / (SELECT count(*) FROM orders), 4) AS share
FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def status_share_rollup(spark, d):
    """Count, share and a total row."""
    o = t(spark, d, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n"))
    total = F.max("n").over(W.partitionBy())  # over the few rows of the rollup
    return o.select(F.coalesce("o_orderstatus", F.lit("TOTAL")).alias("status"), "n", F.round(F.col("n") * 100.0 / total, 4).alias("share"))


@query("AGG-3 FUN-D1", """
SELECT coalesce(strftime(o_orderdate, '%Y-%m'), 'unknown') AS month, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 1) AS amount
FROM orders GROUP BY 1""")
def monthly_trend(spark, d):
    """Rows by year and month; rows without a date have a bucket of their own."""
    return t(spark, d, "orders").groupBy(F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("unknown")).alias("month")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("amount"))


@query("ORD-5 AGG-1", """
SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 10""")
def top_segments(spark, d):
    """The ten most frequent keys, ties by key."""
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(10)


@query("AGG-4 AGG-32", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high,
       CAST(count(DISTINCT user_id) AS BIGINT) AS users, bool_or(value IS NULL) AS any_missing FROM events GROUP BY 1""")
def kpi_conditional_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.countDistinct("user_id").alias("users"),
        F.bool_or(F.col("value").isNull()).alias("any_missing"))


@query("FLT-21 FUN-D2", f"""
SELECT p.period, CAST(count(o.o_orderkey) AS BIGINT) AS n
FROM (VALUES ('month', TIMESTAMP '{NOW}' - INTERVAL 1 MONTH), ('quarter', TIMESTAMP '{NOW}' - INTERVAL 3 MONTH),
             ('year', TIMESTAMP '{NOW}' - INTERVAL 12 MONTH), ('week', TIMESTAMP '{NOW}' - INTERVAL 7 DAY)) p(period, since)
LEFT JOIN orders o ON o.o_orderdate >= p.since AND o.o_orderdate <= TIMESTAMP '{NOW}' GROUP BY 1""")
def relative_window_filter(spark, d):
    """Rows within a week, month, quarter and year before a given moment: one pass, all periods as conditional counts."""
    now = F.lit(NOW).cast("timestamp")
    since = {"week": now - F.expr("INTERVAL 7 DAY"), "month": F.add_months(now, -1), "quarter": F.add_months(now, -3), "year": F.add_months(now, -12)}
    o = t(spark, d, "orders").where(F.col("o_orderdate") <= now)
    row = o.agg(*[F.count_if(F.col("o_orderdate") >= s).alias(k) for k, s in since.items()])
    return row.select(F.expr("stack(4, " + ", ".join(f"'{k}', {k}" for k in since) + ") AS (period, n)"))


@query("FLT-20 FUN-D3", """
SELECT event_id, user_id, event_type FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10' + INTERVAL 1 DAY AND contains(lower(props), '7')""")
def audit_filter(spark, d):
    """Action, from the start of a day to the end of another, free text; day bounds stay on the bare column so that they
    reach the scan."""
    e = t(spark, d, "events")
    lo, hi = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz")
    return e.where((F.col("event_type") == "click") & (F.col("ts") >= lo) & (F.col("ts") < hi) & F.lower("props").contains("7")).select("event_id", "user_id", "event_type")


@query("FLT-19 FLT-18 FUN-S8", """
SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name), 'a1') OR contains(lower(p_brand), '#1') OR contains(lower(p_type), 'eco')) AND p_size > 10""")
def search_multi_field(spark, d):
    fields = (("p_name", "a1"), ("p_brand", "#1"), ("p_type", "eco"))
    any_of = F.lit(False)
    for c, q in fields:
        any_of = any_of | F.lower(c).contains(q)
    return t(spark, d, "part").where(any_of & (F.col("p_size") > 10)).select("p_partkey", "p_name", "p_brand")


@query("ORD-8", """
WITH n AS (SELECT count(*) AS n FROM customer), p AS (SELECT least(3, greatest(1, CAST(ceil(n / 25.0) AS BIGINT))) AS page FROM n)
SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET (SELECT (page - 1) * 25 FROM p)""")
def paginate_page3(spark, d):
    """Page 3 of 25, clamped to the last page; a top-k plan, not a global sort."""
    c = t(spark, d, "customer")
    page = min(3, max(1, -(-c.count() // 25)))
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").offset((page - 1) * 25).limit(25).select("c_custkey", "c_name")


@query("FLT-22 FLT-23", """
SELECT p.principal, c.c_custkey FROM (VALUES ('admin', NULL), ('region_lead', 1), ('owner', NULL)) p(principal, region)
JOIN customer c ON TRUE JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE (p.principal = 'admin' AND c.c_acctbal < 0) OR (p.principal = 'region_lead' AND n.n_regionkey = p.region) OR (p.principal = 'owner' AND c.c_custkey % 100 = 7)""")
def row_level_security(spark, d):
    """Which rows each principal may see: one predicate a role; each row is looked at once, whatever the number of roles."""
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = F.array_compact(F.array(
        F.when(F.col("c_acctbal") < 0, "admin"), F.when(F.col("n_regionkey") == 1, "region_lead"), F.when(F.col("c_custkey") % 100 == 7, "owner")))
    return c.select(F.explode(seen).alias("principal"), "c_custkey")


@query("JOIN-22 JOIN-20", """
SELECT n_name, coalesce(r_name, 'unknown') AS region, CAST(count(c_custkey) AS BIGINT) AS customers
FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def lookup_names(spark, d):
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))  # before the join
    n = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        "n_name", F.coalesce("r_name", F.lit("unknown")).alias("region"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("JOIN-26", """
SELECT coalesce(c.k, s.k) AS nationkey, CAST(coalesce(c.n, 0) AS BIGINT) AS customers, CAST(coalesce(s.n, 0) AS BIGINT) AS suppliers,
  CASE WHEN c.k IS NULL THEN 'only supplier' WHEN s.k IS NULL THEN 'only customer' WHEN c.n > s.n THEN 'more customers' ELSE 'ok' END AS verdict
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""")
def full_outer_reconcile(spark, d):
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("c"))
    s = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("s"))
    return c.join(s, "nationkey", "full_outer").select(
        "nationkey", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"),
        F.when(F.col("c").isNull(), "only supplier").when(F.col("s").isNull(), "only customer").when(F.col("c") > F.col("s"), "more customers").otherwise("ok").alias("verdict"))


@query("JOIN-21 SET-1", """
SELECT 'owner' AS recipient, c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name IS NOT NULL
UNION ALL SELECT 'supplier', s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_name IS NOT NULL
UNION ALL SELECT 'desk', CAST(n_nationkey AS BIGINT), n_name FROM nation""")
def notify_fanout(spark, d):
    """One event to many recipients: a union of equi joins, recipients without an address left out."""
    n = F.broadcast(t(spark, d, "nation"))
    a = t(spark, d, "customer").where("c_name is not null").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("owner").alias("recipient"), F.col("c_custkey").alias("k"), "n_name")
    b = t(spark, d, "supplier").where("s_name is not null").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("supplier").alias("recipient"), F.col("s_suppkey").alias("k"), "n_name")
    c = t(spark, d, "nation").select(F.lit("desk").alias("recipient"), F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return a.unionByName(b).unionByName(c)


@query("ORD-2 ORD-3 FLT-24 AGG-5", """
SELECT o_orderpriority AS severity, coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), 4) AS rank,
       CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""")
def severity_order(spark, d):
    """Counts by severity with the rank that orders them; unknown severities come last."""
    order = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    pos = F.array_position(order, F.col("o_orderpriority"))
    return (t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"))
            .select("severity", F.when(F.array_contains(order, F.col("severity")), F.array_position(order, F.col("severity"))).otherwise(4).cast("int").alias("rank"), "n").orderBy("rank", "severity"))


@query("AGG-16", """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v, min(ts) AS a, max(ts) AS b FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, round(v[CAST(floor(len(v) * 0.9) AS INT) + 1], 6) AS p90, round((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2, 6) AS middle, CAST(len(v) AS BIGINT) AS n,
 round(CASE WHEN b > a THEN len(v) * 60.0 / (epoch(b) - epoch(a)) ELSE 0 END, 6) AS per_minute FROM s""")
def nearest_rank_p90(spark, d):
    """The element at floor(0.9 n) of the sorted values, the median and the throughput. Values get their place within the key
    by a global sort, so that no key's values are held by one task; only the three places asked for are kept."""
    e = t(spark, d, "events").where("value is not null").select("event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    n = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    r = rank_in_key(e.select("event_type", "value"), ["event_type"], ["value"]).join(n.withColumnRenamed("event_type", "k"), F.col("event_type").eqNullSafe(F.col("k")))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("value")))
    half = lambda k: F.floor(k / 2).cast("bigint")
    g = r.groupBy("event_type", "n", "a", "b").agg(at(F.floor(F.col("n") * F.lit(0.9)) + 1).alias("p90"), at(half(F.col("n") + 1)).alias("lo"), at(half(F.col("n")) + 1).alias("hi"))
    rate = F.when(F.col("b") > F.col("a"), F.col("n") * 60e6 / (F.col("b") - F.col("a"))).otherwise(0.0)
    return g.select("event_type", F.round("p90", 6).alias("p90"), F.round((F.col("lo") + F.col("hi")) / 2, 6).alias("middle"), "n", F.round(rate, 6).alias("per_minute"))


@query("AGG-36", """
SELECT l_returnflag, round(sum(x * CASE WHEN q <= 0 THEN 1 ELSE q END), 0) AS weighted, round(sum(x), 1) AS plain FROM (
  SELECT l_returnflag, coalesce(try_cast(CAST(l_tax AS VARCHAR) AS DOUBLE), 0) AS x, l_quantity - 25 AS q FROM lineitem) GROUP BY 1""")
def weighted_totals(spark, d):
    """Column totals weighted by quantity; a quantity of 0 or less counts as one, what can't be read as 0."""
    x = F.coalesce(F.expr("try_cast(cast(l_tax as string) as double)"), F.lit(0.0))
    q = F.col("l_quantity") - 25
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(x * F.when(q <= 0, 1).otherwise(q)), 0).alias("weighted"), F.round(F.sum(x), 1).alias("plain"))


@query("WIN-18", """
WITH s AS (SELECT l_returnflag AS k, count(*) * 100.0 / (SELECT count(*) FROM lineitem) AS pct FROM lineitem GROUP BY 1)
SELECT k, round(pct, 4) AS pct, round(coalesce(sum(pct) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start FROM s""")
def donut_offsets(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    s = s.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))  # over the few groups
    before = F.sum("pct").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    return s.select("k", F.round("pct", 4).alias("pct"), F.round(F.coalesce(before, F.lit(0.0)), 4).alias("start"))


@query("AGG-13", """
WITH pop AS (SELECT o_orderpriority AS tier, count(*) AS n FROM orders GROUP BY 1),
     s AS (SELECT o_orderpriority AS tier, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS k FROM orders WHERE o_orderkey % 10 = 3 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS population, CAST(sum(k) AS BIGINT) AS looked_at, round(sum(rate * n) / sum(n), 6) AS estimate FROM pop JOIN s USING (tier)""")
def stratified_estimate(spark, d):
    """Rate per tier of those looked at, times the tier's population: one pass with conditional aggregates."""
    looked = F.col("o_orderkey") % 10 == 3
    tiers = t(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(looked).alias("k"), F.avg(F.when(looked, F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))).alias("rate"))
    return tiers.where("k > 0").agg(F.sum("n").alias("population"), F.sum("k").alias("looked_at"), F.round(F.sum(F.col("rate") * F.col("n")) / F.sum("n"), 6).alias("estimate"))


@query("AGG-29 JOIN-12", """
WITH g AS (SELECT * FROM (VALUES (1), (5), (20)) a(gap) CROSS JOIN (VALUES (0.0), (0.05)) b(tol))
SELECT g.gap, CAST(g.tol AS DOUBLE) AS tol, CAST(count(l.l_orderkey) AS BIGINT) AS n FROM g LEFT JOIN lineitem l ON l.l_quantity <= g.gap AND l.l_discount <= g.tol GROUP BY 1, 2""")
def sweep_grid(spark, d):
    """How many rows pass at each point of a grid of thresholds: rows are counted by the least point they pass, then the
    few counts meet the grid."""
    gaps, tols = (1, 5, 20), (0.0, 0.05)
    least = lambda c, xs: F.coalesce(*[F.when(F.col(c) <= x, F.lit(float(x))) for x in xs])
    c = t(spark, d, "lineitem").groupBy(least("l_quantity", gaps).alias("g0"), least("l_discount", tols).alias("t0")).agg(F.count("*").alias("c"))
    grid = spark.createDataFrame([(g, x) for g in gaps for x in tols], "gap int, tol double")
    return grid.join(F.broadcast(c), (F.col("g0") <= F.col("gap")) & (F.col("t0") <= F.col("tol")), "left").groupBy("gap", "tol").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


@query("ORD-12", """
SELECT o_orderpriority AS tier, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS r FROM orders) WHERE r <= 5""")
def stratified_sample_frozen(spark, d):
    """Five rows a tier, by a fixed mix of the key, so that the sample stays the same. row_number with a limit keeps five
    rows a tier and task before the shuffle."""
    w = W.partitionBy("o_orderpriority").orderBy((F.col("o_orderkey") * 7919) % 10007, "o_orderkey")
    return t(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 5").select(F.col("o_orderpriority").alias("tier"), "o_orderkey")


@query("AGG-14", """
SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'brass') THEN 'brass' ELSE 'other' END AS theme,
       CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands FROM part GROUP BY 1""")
def theme_counts(spark, d):
    theme = F.when(F.lower("p_type").contains("steel"), "steel").when(F.lower("p_type").contains("brass"), "brass").otherwise("other")
    return t(spark, d, "part").groupBy(theme.alias("theme")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


THEMES = [("metal", "steel"), ("metal", "brass"), ("metal", "copper"), ("finish", "brushed"), ("finish", "polished"), ("size", "small"), ("size", "large"), ("size", "economy")]


@query("JOIN-23 JOIN-18", f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(map(str, THEMES))}) k(theme, word)), m AS (SELECT DISTINCT p_partkey, p_brand, theme FROM part JOIN k ON list_contains(string_split(lower(p_type), ' '), k.word))
SELECT theme, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands FROM m GROUP BY 1 UNION ALL SELECT 'none', CAST(count(*) AS BIGINT), CAST(count(DISTINCT p_brand) AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM m)""")
def theme_join(spark, d):
    """Rows by the themes of a keyword table, by an equi join on their words; a row may have several themes, or none."""
    k = spark.createDataFrame(THEMES, "theme string, word string")
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.explode(F.split(F.lower("p_type"), " ")).alias("word"))
    m = p.join(k, "word", "left").groupBy("p_partkey", "p_brand", "theme").agg(F.lit(1).alias("one"))
    hit = m.where("theme is not null").groupBy("theme").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))
    bare = m.groupBy("p_partkey", "p_brand").agg(F.max("theme").alias("any")).where("any is null").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))
    return hit.unionByName(bare.select(F.lit("none").alias("theme"), "n", "brands"))


@query("JOIN-8 AGG-25 AGG-24", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS q FROM lineitem WHERE l_returnflag = 'R'),
     b AS (SELECT p_partkey, p_size, p_brand FROM part),
     m AS (SELECT a.l_orderkey, a.l_linenumber, b.p_brand, abs(a.q - b.p_size) AS dist FROM a JOIN b ON a.l_partkey = b.p_partkey AND abs(a.q - b.p_size) <= 3)
SELECT l_orderkey, l_linenumber, min(dist) AS dist, CAST(count(DISTINCT p_brand) AS BIGINT) AS labels FROM m GROUP BY 1, 2 HAVING count(DISTINCT p_brand) = 1""")
def theta_value_page_match(spark, d):
    """Equal on the key, within a band on the other number; what has several labels in the nearest tier is dropped."""
    a = t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    b = t(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    m = a.join(b, F.col("l_partkey") == F.col("p_partkey")).withColumn("dist", F.abs(F.col("q") - F.col("p_size"))).where("dist <= 3")
    return m.groupBy("l_orderkey", "l_linenumber").agg(F.min("dist").alias("dist"), F.countDistinct("p_brand").alias("labels")).where("labels = 1")


@query("JOIN-9", """
WITH direct AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 40),
     own AS (SELECT l_orderkey, min(l_suppkey) AS supp FROM direct GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
SELECT l.l_orderkey, l.l_linenumber, o.supp FROM lineitem l JOIN own o USING (l_orderkey)
WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber)""")
def inherit_by_line(spark, d):
    """What has no match of its own inherits that of its line, where the line has exactly one."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)).alias("direct"))
    lines = li.where("direct").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp"), F.max("l_suppkey").alias("top"), F.collect_set("l_linenumber").alias("own"))
    return li.join(lines.where("supp = top"), "l_orderkey").where(~F.array_contains("own", F.col("l_linenumber"))).select("l_orderkey", "l_linenumber", "supp")


@query("AGG-12", """
SELECT o_orderstatus AS actual, CAST(count(*) FILTER (WHERE p = 'F') AS BIGINT) AS predicted_f, CAST(count(*) FILTER (WHERE p = 'O') AS BIGINT) AS predicted_o,
       round(avg(CASE WHEN p = o_orderstatus THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN p <> '?' THEN CASE WHEN p = o_orderstatus THEN 1.0 ELSE 0.0 END END), 6) AS when_decided
FROM (SELECT o_orderstatus, CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_totalprice < 100000 THEN 'O' ELSE '?' END AS p FROM orders) GROUP BY 1""")
def confusion_matrix(spark, d):
    p = F.when(F.col("o_totalprice") > 250000, "F").when(F.col("o_totalprice") < 100000, "O").otherwise("?")
    o = t(spark, d, "orders").select("o_orderstatus", p.alias("p"))
    hit = F.when(F.col("p") == F.col("o_orderstatus"), 1.0).otherwise(0.0)
    return o.groupBy(F.col("o_orderstatus").alias("actual")).agg(
        F.count_if(F.col("p") == "F").alias("predicted_f"), F.count_if(F.col("p") == "O").alias("predicted_o"),
        F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("p") != "?", hit)), 6).alias("when_decided"))


@query("SNK-9 PRJ-3 PRJ-5", """
SELECT '"' || replace(p_name, '"', '""') || '","' || replace(p_brand, '"', '""') || '",' || p_size AS line FROM part""")
def csv_lines(spark, d):
    """Rows as CSV with doubled quotes."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return t(spark, d, "part").select(F.concat_ws(",", quoted("p_name"), quoted("p_brand"), F.col("p_size").cast("string")).alias("line"))
