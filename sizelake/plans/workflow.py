"""Queries over project records, revisions and events: orphans, replay, differences, logs, windows of time."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sizelake.functions import text as X
from sizelake.functions.json_walk import canonical_hash
from sizelake.operators.matching import cascade, first_fit, rank_in_key, sequence_diff
from sizelake.operators.review_sheets import review_labels
from sizelake.operators.running import running
from sizelake.plans.documents import WS, elements
from sizelake.plans.registry import query
from sizelake.sources.tables import table as t

CONTENT = [
    "yeu_cau_bai_toan_content", "thong_tin_dau_vao_content", "mo_hinh_he_thong_content", "dinh_co_he_thong_content", "tong_hop_va_de_xuat_content",
    "tonghop_admin_review", "yeu_cau_admin_review", "thong_tin_admin_review", "mohinh_admin_review", "dinhco_admin_review",
]


@query("JOIN-17", """
SELECT DISTINCT p.id, p.project_id FROM project_data p LEFT JOIN project_revisions r ON r.project_id = p.project_id WHERE r.id IS NULL""")
def orphan_anti_join(spark, d):
    p = t(spark, d, "project_data").select("id", "project_id").distinct()
    return p.join(t(spark, d, "project_revisions").where("id is not null").select("project_id"), "project_id", "left_anti").select("id", "project_id")


@query("JOIN-18 JOIN-20", """
SELECT DISTINCT a.id, a.project_id, b.project_id AS baseline_project FROM project_revisions a JOIN project_revisions b ON a.baseline_id = b.id WHERE a.project_id <> b.project_id""")
def self_join_mismatch(spark, d):
    """Revisions whose baseline belongs to another project."""
    r = t(spark, d, "project_revisions").select("id", "project_id", "baseline_id").distinct()
    b = r.select(F.col("id").alias("baseline_id"), F.col("project_id").alias("baseline_project")).distinct()
    return r.join(b, "baseline_id").where("project_id <> baseline_project").select("id", "project_id", "baseline_project").distinct()


@query("JOIN-19", "SELECT project_id, min(id) AS id, CAST(count(DISTINCT id) - 1 AS BIGINT) AS dropped FROM project_data WHERE project_id IS NOT NULL GROUP BY 1")
def dedup_keep_min(spark, d):
    return t(spark, d, "project_data").where("project_id is not null").groupBy("project_id").agg(F.min("id").alias("id"), (F.countDistinct("id") - 1).alias("dropped"))


LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, length(snapshot_content) DESC, snapshot_content DESC) AS k FROM project_revisions) WHERE k = 1)"


def delivered(spark, d):
    """Each revision as it was received last; ties to the longer, then the greater content."""
    r = t(spark, d, "project_revisions")
    cols = [c for c in r.columns if c not in ("id", "received_at", "snapshot_content")]
    best = r.groupBy("id").agg(F.max_by(F.struct(*cols, "received_at", "snapshot_content"), F.struct("received_at", F.length("snapshot_content").alias("n"), "snapshot_content")).alias("x"))
    return best.select("id", "x.*")


@query("WIN-14 FUN-P2", f"""
WITH {LAST}, b AS (SELECT project_id, max(created_at) AS since FROM last WHERE revision_type = 'BASELINE' AND json_valid(snapshot_content) GROUP BY 1),
 f AS (SELECT l.project_id, l.id, l.created_at, unnest(json_keys(l.snapshot_content)) AS field FROM last l JOIN b ON b.project_id = l.project_id AND l.created_at >= b.since WHERE json_valid(l.snapshot_content) AND json_type(l.snapshot_content) = 'OBJECT')
SELECT project_id, field, max_by(id, (created_at, id)) AS revision_id FROM f GROUP BY 1, 2""")
def revision_replay(spark, d):
    """The state at the last revision: per field the revision that wrote it last, from the latest baseline on. Both steps are
    aggregates that combine before the shuffle."""
    r = delivered(spark, d).select("id", "project_id", "created_at", "revision_type", F.map_keys(F.from_json("snapshot_content", "map<string,string>")).alias("fields")).where("fields is not null and size(fields) > 0")
    b = r.where("revision_type = 'BASELINE'").groupBy("project_id").agg(F.max("created_at").alias("since"))
    f = r.join(b, "project_id").where("created_at >= since").select("project_id", "id", "created_at", F.explode("fields").alias("field"))
    return f.groupBy("project_id", "field").agg(F.max_by("id", F.struct("created_at", "id")).alias("revision_id"))


@query("STR-8", f"""
WITH {LAST}, n AS (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS r FROM last)
SELECT id, CAST(floor((r - 1) / 11) + 1 AS BIGINT) AS segment, (r - 1) % 11 = 0 AS baseline FROM n""")
def revision_baseline_every_10(spark, d):
    """Segments of a baseline and up to ten increments, in the order of creation; a project may have any number."""
    r = delivered(spark, d).select("id", "project_id", "created_at")
    r = rank_in_key(r, ["project_id"], ["created_at", "id"])
    return r.select("id", (F.floor((F.col("rank") - 1) / 11) + 1).alias("segment"), ((F.col("rank") - 1) % 11 == 0).alias("baseline"))


def consecutive(df, key: str, order: str, columns: list[str]):
    """(key, a, b, x, y) for each row of a key and the next one in order: their order values and their columns as structs. A
    key may have any number of rows."""
    r = rank_in_key(df.where(F.col(key).isNotNull()).select(key, order, *columns), [key], [order])
    x = r.select(key, "rank", F.col(order).alias("a"), F.struct(*columns).alias("x"))
    y = r.select(key, (F.col("rank") - 1).alias("rank"), F.col(order).alias("b"), F.struct(*columns).alias("y"))
    return x.join(y, [key, "rank"]).drop("rank")


NEXT = f"""p AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS r, {", ".join(CONTENT)} FROM (SELECT DISTINCT * FROM project_data WHERE project_id IS NOT NULL)),
 j AS (SELECT x.project_id, y.id AS later, unnest([{", ".join(f"{{'f': '{c}', 'o': x.{c}, 'n': y.{c}}}" for c in CONTENT)}]) AS u FROM p x JOIN p y ON x.project_id = y.project_id AND y.r = x.r + 1)"""


@query("FUN-J2 SNK-10", f"""
WITH {NEXT} SELECT project_id, later, u.f AS field, CASE WHEN u.o IS NULL THEN 'set' WHEN u.n IS NULL THEN 'cleared' ELSE 'changed' END AS change, md5(coalesce(u.n, u.o)) AS merged FROM j WHERE u.o IS DISTINCT FROM u.n""")
def json_diff_fields(spark, d):
    """Fields that differ between each row of a project and the next, and what a merge that never clears would hold."""
    x = consecutive(t(spark, d, "project_data").select("id", "project_id", *CONTENT).distinct(), "project_id", "id", CONTENT)
    u = x.select("project_id", F.col("b").alias("later"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"x.{c}").alias("o"), F.col(f"y.{c}").alias("n")) for c in CONTENT])).alias("u")).select("project_id", "later", "u.*")
    change = F.when(F.col("o").isNull(), "set").when(F.col("n").isNull(), "cleared").otherwise("changed")
    return u.where(~F.col("o").eqNullSafe(F.col("n"))).select("project_id", "later", "field", change.alias("change"), F.md5(F.encode(F.coalesce("n", "o"), "UTF-8")).alias("merged"))


@query("SET-9")
def version_diff(spark, d):
    """How the sizing text of each row of a project differs from that of the next, in blocks of lines."""
    p = t(spark, d, "project_data").select("id", "project_id", "dinh_co_he_thong_content").distinct()
    two = consecutive(p, "project_id", "id", ["dinh_co_he_thong_content"])
    return two.select("project_id", "b", sequence_diff(F.col("x.dinh_co_he_thong_content"), F.col("y.dinh_co_he_thong_content")).alias("x")).select("project_id", F.col("b").alias("later"), "x.*")


_J = "len(list_intersect(f.w, {0})) * 1.0 / len(list_distinct(list_concat(f.w, {0})))"


@query("SET-5", f"""
WITH RECURSIVE i AS (SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY item_id) AS k, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda x: length(x) > 1)) AS w FROM eval_items),
 g(category, k, item_id, own, firsts) AS (SELECT DISTINCT category, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(id BIGINT, w VARCHAR[])[]) FROM i
  UNION ALL SELECT g.category, i.k, i.item_id, coalesce(list_filter(g.firsts, lambda f: {_J.format("i.w")} >= 0.6)[1].id, i.item_id),
   CASE WHEN len(list_filter(g.firsts, lambda f: {_J.format("i.w")} >= 0.6)) > 0 THEN g.firsts ELSE list_append(g.firsts, {{'id': i.item_id, 'w': i.w}}) END FROM g JOIN i ON i.category = g.category AND i.k = g.k + 1)
SELECT category, item_id, own AS first_item FROM g WHERE k > 0""")
def first_fit_clusters(spark, d):
    """Remarks of a category clustered in order: each joins the first cluster whose first member has words alike."""
    i = t(spark, d, "eval_items").select("category", "item_id", X.tokens(F.col("text")).alias("w"))
    return first_fit(i, "category", "item_id", "w").withColumnRenamed("first", "first_item")


def _pass(no: int, keys: str, left: str, right: str) -> str:
    some = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    rank = lambda i, x: f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {i}) AS k FROM {x} WHERE {some})"
    return f"""p{no} AS (SELECT value_id, number_id, {no} AS pass FROM {rank("value_id", left)} x JOIN {rank("number_id", right)} y USING ({keys}, k)),
 a{no} AS (SELECT * FROM {left} WHERE value_id NOT IN (SELECT value_id FROM p{no})), b{no} AS (SELECT * FROM {right} WHERE number_id NOT IN (SELECT number_id FROM p{no}))"""


@query("JOIN-11", f"""
WITH a AS (SELECT DISTINCT value_id, doc_id, scope_key, name, trim(gia_tri_nguyen_van) AS raw FROM gia_tri_so), b AS (SELECT DISTINCT number_id, doc_id, scope_key, name, trim(gia_tri_raw) AS raw FROM so_lieu_anh),
 {_pass(1, "doc_id, scope_key, name, raw", "a", "b")}, {_pass(2, "doc_id, scope_key, name", "a1", "b1")}, {_pass(3, "doc_id, scope_key", "a2", "b2")}
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""")
def cascade_pairs(spark, d):
    """Values paired with image numbers of their document one to one: by name and reading, else by name, else by what is
    left of the scope."""
    a = t(spark, d, "gia_tri_so").select("value_id", "doc_id", "scope_key", "name", F.trim("gia_tri_nguyen_van").alias("raw")).dropDuplicates(["value_id"])
    b = t(spark, d, "so_lieu_anh").select("number_id", "doc_id", "scope_key", "name", F.trim("gia_tri_raw").alias("raw")).dropDuplicates(["number_id"])
    return cascade(a, b, "value_id", "number_id", [["doc_id", "scope_key", "name", "raw"], ["doc_id", "scope_key", "name"], ["doc_id", "scope_key"]])


@query("FUN-J1 FUN-J3", """
WITH x AS (SELECT event_id, props, '{' || array_to_string(list_sort(list_transform(json_keys(props), lambda k: '"' || k || '":' || json_extract(props, '$."' || k || '"'))), ',') || '}' AS c FROM events)
SELECT event_id, coalesce(props->>'$.k', '') AS k, CASE WHEN props IS NOT NULL THEN sha256(c) END AS canonical FROM x""")
def json_path_fields(spark, d):
    """A field of each event's properties, and the hash of the properties in canonical form: keys in order, no blanks."""
    e = t(spark, d, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), canonical_hash(F.col("props")).alias("canonical"))


@query("FUN-S10", """
WITH x AS (SELECT DISTINCT id, mo_hinh_he_thong_content AS c FROM project_data WHERE contains(mo_hinh_he_thong_content, '<'))
SELECT id, CAST(len(regexp_extract_all(c, '<[a-zA-Z][^>]*>')) AS BIGINT) AS tags, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(c, '(?i)<br\\s*/?>|</p>|</div>|</li>|</tr>', '\n', 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&hellip;', '…'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM x""")
def html_to_text(spark, d):
    x = t(spark, d, "project_data").where(F.contains("mo_hinh_he_thong_content", F.lit("<"))).select("id", F.col("mo_hinh_he_thong_content").alias("c")).distinct()
    return x.select("id", F.size(F.regexp_extract_all("c", F.lit("(<[a-zA-Z][^>]*>)"), 1)).cast("long").alias("tags"), F.trim(F.regexp_replace(X.html_to_text(F.col("c")), r"\s+", " ")).alias("text"))


@query("SNK-12 PRJ-4", """
SELECT DISTINCT id, CASE WHEN length(yeu_cau_bai_toan_content) > 60 THEN left(yeu_cau_bai_toan_content, 57) || '...' ELSE yeu_cau_bai_toan_content END AS entry FROM project_data""")
def limited_log(spark, d):
    return t(spark, d, "project_data").select("id", X.cut_hard(F.col("yeu_cau_bai_toan_content"), 60).alias("entry")).distinct()


@query("STR-2 STR-4", """
SELECT user_id, max_by(event_type, (ts, event_id)) AS state, max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY AS expired FROM events GROUP BY 1""")
def job_states(spark, d):
    """The last state of each job and whether it is past its time to live."""
    e = t(spark, d, "events")
    ttl = F.lit("2024-01-29").cast("timestamp_ntz")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), (F.max("ts") < ttl).alias("expired"))


@query("STR-5 SNK-4", """
WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, event_id, event_type FROM x WHERE prev IS NULL OR prev <> event_type""")
def change_only_append(spark, d):
    """Only rows that change the state of their key."""
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    r = running(e, "user_id", ["ts", "event_id"], lasts={"prev": F.col("event_type")}, inclusive=False)
    return r.where("prev is null or prev <> event_type").select("user_id", "event_id", "event_type")


@query("STR-11", """
SELECT CAST(strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M') AS VARCHAR) AS w, event_type, CAST(count(*) AS BIGINT) AS n, round(max(value), 4) AS top FROM events GROUP BY 1, 2""")
def tumbling_events(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("w"), "event_type", "n", "top")


@query("STR-11", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    """Sessions with a gap of a day; the session window merges partial sessions before the shuffle."""
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


VERSIONS = """d AS (SELECT source, doc_id, loai, coalesce(strftime(modified, '%Y-%m-%d'), '9999-99-99') AS m FROM documents WHERE source IS NOT NULL), r AS (SELECT source, max(m) AS last FROM d WHERE loai = 'phieu_nhan_xet' AND m <> '9999-99-99' GROUP BY 1),
 k AS (SELECT d.*, r.last IS NULL OR d.m = '9999-99-99' OR d.m <= r.last AS ok FROM d LEFT JOIN r USING (source) WHERE loai <> 'phieu_nhan_xet'), f AS (SELECT source, bool_or(ok) AS any_ok FROM k GROUP BY 1),
 v AS (SELECT k.source, k.doc_id, k.m FROM k JOIN f USING (source) WHERE k.ok OR NOT f.any_ok)"""


def versions(spark, d):
    """(source, doc_id, m): versions of a dossier up to its last review, undated ones among them; all if that leaves none."""
    x = t(spark, d, "documents").where("source is not null").select("source", "doc_id", "loai", F.coalesce(F.date_format("modified", "yyyy-MM-dd"), F.lit("9999-99-99")).alias("m"))
    last = x.groupBy("source").agg(F.max(F.when((F.col("loai") == "phieu_nhan_xet") & (F.col("m") != "9999-99-99"), F.col("m"))).alias("last"))
    v = x.where("loai <> 'phieu_nhan_xet'").join(last, "source").withColumn("ok", F.col("last").isNull() | (F.col("m") == "9999-99-99") | (F.col("m") <= F.col("last")))
    return v.join(v.groupBy("source").agg(F.bool_or("ok").alias("any_ok")), "source").where("ok or not any_ok").select("source", "doc_id", "m")


@query("ORD-10 FLT-14", f"WITH {VERSIONS} SELECT source, min_by(doc_id, (m, doc_id)) AS first_version, CAST(count(*) AS BIGINT) AS versions FROM v GROUP BY 1")
def version_filter(spark, d):
    """The first of a dossier's versions, by date and id, undated last, and how many there are."""
    return versions(spark, d).groupBy("source").agg(F.min(F.struct("m", "doc_id"))["doc_id"].alias("first_version"), F.count("*").alias("versions"))


@query("ORD-11", f"""
WITH {VERSIONS}, n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY m, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM v), q AS (SELECT source, CAST(unnest(range(1, max(vong) + 1)) AS INT) AS round FROM documents WHERE vong IS NOT NULL AND source IS NOT NULL GROUP BY source)
SELECT q.source, q.round, n.doc_id FROM q JOIN n ON n.source = q.source AND n.k = least(q.round, n.n)""")
def version_of_round(spark, d):
    """The version that each round of review read: the n-th for round n, the last where there are fewer."""
    v = rank_in_key(versions(spark, d), ["source"], ["m", "doc_id"])
    n = v.groupBy("source").agg(F.count("*").alias("n"))
    r = t(spark, d, "documents").where("vong is not null and source is not null").groupBy("source").agg(F.max("vong").alias("last"))
    asked = r.join(n, "source").select("source", F.explode(F.sequence(F.lit(1), "last")).alias("round"), "n").withColumn("rank", F.least(F.col("round").cast("bigint"), "n"))
    return asked.join(v.select("source", "rank", "doc_id"), ["source", "rank"]).select("source", "round", "doc_id")


@query("AGG-15", """
WITH c AS (SELECT loai, vong, count(*) AS n FROM documents WHERE vong IS NOT NULL GROUP BY 1, 2)
SELECT loai, vong, CAST(n AS BIGINT) AS n, round(sum(n * vong) OVER (PARTITION BY loai) * 1.0 / sum(n) OVER (PARTITION BY loai), 6) AS mean FROM c""")
def round_distribution(spark, d):
    """How many documents of each kind are of each round, and the kind's mean round, from the counts."""
    c = t(spark, d, "documents").where("vong is not null").groupBy("loai", "vong").agg(F.count("*").alias("n"))
    w = W.partitionBy("loai")  # over the few counts
    return c.select("loai", "vong", "n", F.round(F.sum(F.col("n") * F.col("vong")).over(w) / F.sum("n").over(w), 6).alias("mean"))


# fixed values: words of procedure in the names of dossiers
PROCEDURE = ("cap", "moi", "bo", "sung", "cấp", "mới", "bổ", "hệ", "thống", "he", "thong", "sizing", "tai", "nguyen", "tài", "nguyên")
_NAMED = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower(dossier), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN {PROCEDURE} AND NOT regexp_full_match(x, '[0-9]+'))"


@query("FLT-15 FUN-S4", f"""
WITH x AS (SELECT DISTINCT dossier_id, lower(trim(dau_moi_yeu_cau)) AS account, {_NAMED} AS w FROM eval_dossiers WHERE dossier_id IS NOT NULL AND dossier IS NOT NULL AND trim(dau_moi_yeu_cau) <> ''),
 g AS (SELECT account, min_by(w, dossier_id) AS own FROM (SELECT account, dossier_id, min(w) AS w FROM x GROUP BY ALL) GROUP BY 1), k AS (SELECT x.account, x.dossier_id, list_has_any(x.w, g.own) AS hit FROM x JOIN g USING (account)), a AS (SELECT account, bool_or(hit) AS any_hit FROM k GROUP BY 1)
SELECT DISTINCT account, dossier_id FROM k JOIN a USING (account) WHERE hit OR NOT any_hit""")
def versions_by_words(spark, d):
    """Of each account's dossiers those that share a word of substance with its first one; all where none does, as when that
    one has no such word."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("dossier"), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: (F.length(w) > 1) & ~w.isin(*PROCEDURE) & ~w.rlike("^[0-9]+$"))
    x = t(spark, d, "eval_dossiers").where("dossier_id is not null and dossier is not null and trim(dau_moi_yeu_cau) <> ''").select("dossier_id", F.lower(F.trim("dau_moi_yeu_cau")).alias("account"), words.alias("w")).distinct()
    own = x.groupBy("account").agg(F.min(F.struct("dossier_id", "w"))["w"].alias("own"))
    k = x.join(own, "account").select("account", "dossier_id", F.arrays_overlap("w", "own").alias("hit"))
    a = k.groupBy("account").agg(F.bool_or("hit").alias("any_hit"))
    return k.join(a, "account").where("hit or not any_hit").select("account", "dossier_id").distinct()


# names of files as their authors make them
FILE_NAMES = "list_extract(['20240710_', '', 'Copy of ', '2024-', 'bản sao của '], CAST(dossier_id % 5 AS INT) + 1) || lower(dossier) || list_extract(['_v2', ' (1)', '-final', '', ' ok'], CAST(dossier_id % 5 AS INT) + 1) || '.docx'"
_END = "regexp_replace({0}, '[ _-]*(v[0-9]+([.][0-9]+)*|[(][0-9]+[)]|final|ok|new|[0-9]{{4,8}}|_[0-9]+)$', '')"


@query("FUN-S13", f"""
WITH x AS (SELECT DISTINCT dossier_id, {FILE_NAMES} AS name FROM eval_dossiers WHERE dossier IS NOT NULL AND dossier_id IS NOT NULL), s AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[.][a-z0-9]{{2,5}}$', ''), '^([0-9]{{6,8}}[ _-]+|copy of |bản sao của )', '') AS b FROM x)
SELECT dossier_id, name, trim(regexp_replace({_END.format(_END.format(_END.format("b")))}, '[ _-]+', ' ', 'g')) AS family FROM s""")
def file_families(spark, d):
    """Files by what their name says once dates, copy marks and version endings are gone."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("dossier_id") % 5).cast("int") + 1)
    name = F.concat(pick(["20240710_", "", "Copy of ", "2024-", "bản sao của "]), F.lower("dossier"), pick(["_v2", " (1)", "-final", "", " ok"]), F.lit(".docx"))
    x = t(spark, d, "eval_dossiers").where("dossier is not null and dossier_id is not null").select("dossier_id", name.alias("name")).distinct()
    return x.select("dossier_id", "name", X.file_family(F.col("name")).alias("family"))


@query("FUN-S5 FLT-13", """
SELECT dossier_id, list_slice(list_filter(regexp_split_to_array(trim(regexp_replace(lower(dossier), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN ('cap', 'nang')), 1, 5) AS head,
 NOT (regexp_matches(lower(dossier), 'ung cuu|ứng cứu') OR starts_with(dossier, '~$')) AS wanted, split_part(dau_moi_yeu_cau, '@', 1) AS account FROM (SELECT DISTINCT dossier_id, dossier, dau_moi_yeu_cau FROM eval_dossiers)""")
def dossier_names(spark, d):
    """Head words of a dossier's name, whether it passes the name filter, the account before the domain."""
    x = t(spark, d, "eval_dossiers").select("dossier_id", "dossier", "dau_moi_yeu_cau").distinct()
    words = F.split(F.trim(F.regexp_replace(F.lower("dossier"), r"[^\p{L}\p{N}_]+", " ")), " ")
    head = F.slice(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin("cap", "nang")), 1, 5)
    wanted = ~(F.lower("dossier").rlike("ung cuu|ứng cứu") | F.col("dossier").startswith("~$"))
    return x.select("dossier_id", head.alias("head"), wanted.alias("wanted"), F.substring_index("dau_moi_yeu_cau", "@", 1).alias("account"))


@query("SET-8", """
SELECT category, CAST(count(*) FILTER (WHERE split = 'dev') AS BIGINT) AS dev, CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS test, len(list_distinct(list(vong))) AS rounds FROM eval_items GROUP BY 1""")
def split_membership(spark, d):
    i = t(spark, d, "eval_items")
    return i.groupBy("category").agg(F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "test").alias("test"), F.countDistinct("vong").alias("rounds"))


@query("WIN-13", """
WITH e AS (SELECT DISTINCT doc_id, element_index, kind, text FROM elements WHERE doc_id IS NOT NULL AND element_index IS NOT NULL),
 s AS (SELECT *, CASE WHEN kind = 'heading' THEN '' WHEN starts_with(text, 'Xem mục') THEN left(text, 30) END AS mark FROM e)
SELECT doc_id, element_index, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY element_index ROWS UNBOUNDED PRECEDING) AS lead FROM s""")
def lead_carry(spark, d):
    """An opener is carried forward until a heading resets it."""
    mark = F.when(F.col("kind") == "heading", F.lit("")).when(F.col("text").startswith("Xem mục"), F.substring("text", 1, 30))
    return running(elements(spark, d, mark.alias("mark")), "doc_id", ["element_index"], lasts={"lead": F.col("mark")}).select("doc_id", "element_index", "lead")


@query("ORD-9", """
WITH o AS (SELECT * FROM (VALUES ('ROAD', 1), ('AIR', 2)) v(k, r)), b AS (SELECT c_nationkey, max_by(c_custkey, (c_acctbal, c_custkey)) AS best FROM customer GROUP BY 1)
SELECT c_nationkey, best, CAST(row_number() OVER (ORDER BY CASE WHEN c_nationkey % 5 = 0 THEN 1 WHEN c_nationkey % 5 = 1 THEN 2 END NULLS LAST, c_nationkey) AS BIGINT) AS place FROM b""")
def reordered_summary(spark, d):
    """The best row of each key, in a given order of keys, the others behind."""
    b = t(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("best"))
    prio = F.when(F.col("c_nationkey") % 5 == 0, 1).when(F.col("c_nationkey") % 5 == 1, 2)
    return b.select("c_nationkey", "best", F.row_number().over(W.orderBy(prio.asc_nulls_last(), "c_nationkey")).cast("long").alias("place"))


# what a review sheet says, line by line
_PAGES = "list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(text, '[Tt]rang\\s*([0-9]+(\\s*,\\s*[0-9]+)*)', 1), lambda x: regexp_extract_all(x, '[0-9]+'))), lambda x: CAST(x AS INT))))"
_ASK = "(^|[^\\p{L}])(bổ sung|sửa|làm rõ|lập|bỏ|cập nhật|giải thích|xem lại|không có|chưa có|không đúng|sai|tại sao|kiểm tra|đánh giá|áp dụng|trình bày|tính lại|tính toán lại)($|[^\\p{L}])"


@query("SRC-14 FUN-S18 FUN-S12", f"""
WITH l AS (SELECT doc_id, vong AS round, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, string_split(text, chr(10)) AS ls FROM documents WHERE loai = 'phieu_nhan_xet' AND text IS NOT NULL),
 x AS (SELECT doc_id, round, n, regexp_replace(regexp_extract(ls[n], '(?s)^{WS[:-1]}*(.*)$', 1), '{WS[:-1]}+$', '') AS line FROM l), y AS (SELECT *, regexp_extract(line, '^([0-9]+)[.)]{WS}', 1) AS no, regexp_replace(line, '^[0-9]+[.)]{WS}', '') AS text FROM x WHERE line <> ''),
 z AS (SELECT *, CASE WHEN regexp_matches(text, '^[(\\s-]*[Tt]rang\\s*[0-9]+(\\s*[,;]\\s*[0-9]+)*\\s*[):.]*$') OR regexp_full_match(text, '(?i)(nhận xét chung|nhận xét)\\s*:?\\s*')
   OR ((regexp_matches(text, '^[Mm]ục\\s*[:.]|^[Mm]ục\\s+([IVX]+(\\.[0-9]+)*|[0-9]+(\\.[0-9]+)+)\\s*[:.]?\\s*.{{0,80}}$|^[Mm]ục\\s+\\S.{{0,60}}$|^[IVX]+\\s*\\.\\s+\\S|^[0-9]+(\\.[0-9]+)+\\s+[A-ZÀ-Ỹ].{{0,70}}$')) AND NOT regexp_matches(lower(text), '{_ASK}') AND NOT contains(text, '?')) THEN 'anchor'
   WHEN ends_with(text, ':') THEN 'lead' ELSE 'request' END AS kind FROM y)
SELECT doc_id, CAST(n - 1 AS INT) AS line_no, round, CASE WHEN no = '' THEN CAST(n AS VARCHAR) ELSE no END AS item, kind, {_PAGES} AS pages, list_filter(regexp_extract_all(text, '[Mm]ục\\s+([IVX]+(\\.[0-9]+)*|[0-9]+(\\.[0-9]+)+)', 1), lambda x: x <> '') AS sections,
 CASE WHEN kind = 'request' THEN nullif(last_value(CASE kind WHEN 'lead' THEN text WHEN 'anchor' THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lead FROM z""")
def review_atoms(spark, d):
    """Every line of every review sheet: round, number, whether it points somewhere, opens what follows or asks for something,
    the pages and sections that it names, and the opener that it stands under."""
    x = t(spark, d, "documents").where("loai = 'phieu_nhan_xet' and text is not null").select("doc_id", F.col("vong").alias("round"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return review_labels(x, "doc_id", "line_no", "line").select("doc_id", "line_no", "round", "item", "kind", "pages", "sections", "lead")


@query("FUN-S21 FUN-S4", """
SELECT rule_id, name, split_part(rule_id, '-', 1) AS grp FROM (SELECT DISTINCT rule_id, name FROM rule_inputs)""")
def rule_groups(spark, d):
    r = t(spark, d, "rule_inputs").select("rule_id", "name").distinct()
    return r.select("rule_id", "name", X.group_code(F.col("rule_id")).alias("grp"))


@query("FUN-S19", """
WITH e AS (SELECT DISTINCT doc_id, element_index, text FROM elements WHERE kind = 'paragraph' AND text <> '' AND doc_id IS NOT NULL AND element_index IS NOT NULL),
 s AS (SELECT doc_id, element_index, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n+', chr(31), 'g'), '([.!?;])[ \\t\\x0b\\f\\r]+', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: length(x) > 25) AS s FROM e)
SELECT doc_id, element_index, CAST(len(s) AS INT) AS sentences, s[1] AS first FROM s""")
def sentence_counts(spark, d):
    """Sentences of each paragraph, short ones left out, and the first of them."""
    e = elements(spark, d, "kind", "text").where("kind = 'paragraph' and text <> ''")
    return e.select("doc_id", "element_index", X.sentences(F.col("text")).alias("s")).select("doc_id", "element_index", F.size("s").alias("sentences"), F.get("s", F.lit(0)).alias("first"))
