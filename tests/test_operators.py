"""Operators on keys of any size, matching in passes, sinks, streams."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sizelake.operators.matching import balanced, cascade, first_fit, rank_in_key, sequence_diff
from sizelake.operators.ordering import dense_index
from sizelake.operators.running import neighbours, running
from sizelake.operators import sinks
from sizelake.streaming import events as S


def test_dense_index(spark):
    n = random.Random(1).sample(range(1000), 300)
    got = dense_index(spark.createDataFrame([(x,) for x in n], "x int"), ["x"]).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.idx)] == sorted(n) and sorted(r.idx for r in got) == list(range(300))
    assert dense_index(spark.createDataFrame([], "x int"), ["x"]).count() == 0
    with pytest.raises(ValueError):
        dense_index(spark.createDataFrame([(1, 2)], "x int, __pos int"), ["x"])


@pytest.mark.parametrize("chunk", [3, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, chunk, inclusive):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, 1, 2]), r.choice([None, "x", "y"])) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, i int, v int, m string")
    got = {(x.k, x.i): (x.s, x.l) for x in running(df, "k", ["i"], sums={"s": F.col("v")}, lasts={"l": F.col("m")}, chunk=chunk, inclusive=inclusive).collect()}
    state = {}
    for k, i, v, m in rows:
        s, l = state.get(k, (0, None))
        after = (s + (v or 0), m if m is not None else l)
        assert got[k, i] == (after if inclusive else (s, l))
        state[k] = after


def test_neighbours(spark):
    rows = [("a" if i % 3 else "b", i, f"t{i}") for i in range(40)]
    got = neighbours(spark.createDataFrame(rows, "k string, i int, t string"), "k", ["i"], "t", 2, chunk=5).collect()
    for r in got:
        own = [x for x in rows if x[0] == r.k]
        at = next(j for j, x in enumerate(own) if x[1] == r.i)
        assert r.before == [x[2] for x in own[max(0, at - 2) : at]] and r.after == [x[2] for x in own[at + 1 : at + 3]]
    assert len(got) == 40


def test_cascade(spark):
    a = spark.createDataFrame([(1, "d", "x", "1"), (2, "d", "x", "2"), (3, "d", "y", None), (4, None, "x", "1")], "a int, doc string, name string, raw string")
    b = spark.createDataFrame([(10, "d", "x", "2"), (11, "d", "x", "9"), (12, "d", "z", None), (13, None, "x", "1")], "b int, doc string, name string, raw string")
    got = {tuple(r) for r in cascade(a, b, "a", "b", [["doc", "name", "raw"], ["doc", "name"], ["doc"]]).collect()}
    assert got == {(2, 10, 1), (1, 11, 2), (3, 12, 3)}
    assert {(r.a, r["rank"]) for r in rank_in_key(a, ["name"], ["a"]).collect()} == {(1, 1), (2, 2), (4, 3), (3, 1)}


def test_first_fit_and_diff(spark):
    df = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["a", "b", "c"]), ("g", 3, ["x"]), ("g", 4, ["a"]), ("h", 1, None)], "g string, o int, w array<string>")
    assert {tuple(r) for r in first_fit(df, "g", "o", "w", 0.6).collect()} == {("g", 1, 1), ("g", 2, 1), ("g", 3, 3), ("g", 4, 4), ("h", 1, 1)}
    r = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), (None, "a"), ("", "")], "a string, b string").select(sequence_diff("a", "b").alias("d")).select("d.*").collect()
    assert (r[0].replaced, r[0].inserted, r[0].deleted) == (1, 1, 0) and r[1].ratio is None and r[2].ratio == 1.0
    assert balanced([("a", 5), ("b", 4), ("c", 3)], ["x", "y"]) == {"a": "x", "b": "y", "c": "y"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "x|y\nz"), ("a", None)], "k string, v string")
    assert sinks.markdown_table(df, ["k"]).splitlines()[2:] == ["| a |  |", "| b | x\\|y z |"]
    with pytest.raises(ValueError):
        sinks.markdown_table(df, ["k"], most=1)
    assert [tuple(r) for r in sinks.upsert(df, spark.createDataFrame([("a", "new"), ("b", None), ("c", "n")], "k string, v string"), "k").orderBy("k").collect()] == [("a", "new"), ("b", "x|y\nz"), ("c", "n")]
    assert sinks.pending(df, df.where("k = 'a'"), ["k"]).count() == 1
    key = df.select(F.sha2(F.to_json(F.struct("k", "v")), 256).alias("key"), F.lit("A").alias("answer"), F.when(F.col("k") == "b", "boom").alias("error"))
    assert {r.k: r.answer for r in sinks.memoised(df, key, ["k", "v"]).collect()} == {"a": "A", "b": None}
    sinks.write_partition(df, str(tmp_path / "p"), "k")
    sinks.write_partition(df.where("k = 'a'").withColumn("v", F.lit("2")), str(tmp_path / "p"), "k")
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"a": "2", "b": "x|y\nz"}
    sinks.write_findings(df, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 2 and sinks.log_entries(df, "v", 4).first().v == "x..."


def event_files(tmp_path, n=3):
    t0 = datetime.datetime(2024, 1, 1)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(n):
        rows = [(k * 10 + i, t0 + datetime.timedelta(hours=k * 24 + i), i % 2, "click", float(i), "{}") for i in range(10)]
        pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / f"events{k}.parquet")
    return str(folder)


def test_stream_equals_batch(spark, tmp_path):
    folder = event_files(tmp_path)
    s = S.event_stream(spark, folder)
    got = S.run_to_end(S.windowed_counts(s, "6 hours"), "w1", "complete", str(tmp_path / "c1"))
    batch = S.windowed_counts(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and got.count() > 0
    assert S.run_to_end(S.windowed_counts(s, "6 hours", "3 hours"), "w2", "append", str(tmp_path / "c2")).count() > 0
    assert S.run_to_end(S.sessions(s, "5 hours"), "w3", "append", str(tmp_path / "c3")).count() > 0
    assert S.run_to_end(S.distinct_events(s), "w4", "append", str(tmp_path / "c4")).count() == 30


def test_append_changes(spark, tmp_path):
    path = str(tmp_path / "log")
    log = lambda: [(r.k, r.v) for r in spark.read.parquet(f"{path}/changes").collect()]
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, n int")
    df = rows((1, "a", 1), (2, "b", 1), (None, "z", 1))
    for epoch in (0, 1, 1):
        S.append_changes(df, epoch, path, ["k"], ["v"], ["n"])
        assert spark.read.parquet(f"{path}/changes").count() == 3
    for _ in range(2):  # a batch that is repeated gives the same
        S.append_changes(rows((1, "c", 1), (2, "b", 1), (3, "x", 1), (3, "x", 2), (3, None, 3), (3, "x", 4)), 2, path, ["k"], ["v"], ["n"])
        assert sorted(map(str, log())) == sorted(map(str, [(1, "a"), (1, "c"), (2, "b"), (None, "z"), (3, "x"), (3, None), (3, "x")]))
    S.append_changes(rows((3, "x", 1), (1, "a", 1), (None, "z", 5)), 3, path, ["k"], ["v"], ["n"])
    assert len(log()) == 8 and spark.read.parquet(f"{path}/last").select("epoch").distinct().count() == 2
    S.append_changes(rows().limit(0), 4, path, ["k"], ["v"], ["n"])
    assert len(log()) == 8 and spark.read.parquet(f"{path}/last").where("epoch = 4").count() == 4


def test_job_states(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    folder = tmp_path / "jobs"
    folder.mkdir()
    batches = ([(1, "waiting"), (1, "running"), (2, "done"), (3, "waiting"), (3, "running")], [(1, "done"), (1, "running"), (2, "waiting")], [(2, "running")], [(9, "waiting")])
    for k, rows in enumerate(batches):
        pd.DataFrame([(k * 10 + i, t0 + datetime.timedelta(hours=k * 10 + i), j, s, 0.0, "") for i, (j, s) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / f"events{k}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = S.run_to_end(S.job_states(S.event_stream(spark, str(folder)), ttl_ms=12 * 3_600_000), "jobs", "update", str(tmp_path / "cj")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    of = lambda j: [(r.state, r.refused) for r in got if r.job == j]
    assert of(1) == [("running", 0), ("done", 1)] and of(2)[:2] == [(None, 1), ("waiting", 0)] and of(2)[2] == ("running", 0)
    assert of(3) == [("running", 0), ("broken", 0)]  # its timer ran out


def test_retries_claims_cache(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0, 1), (2, t0, 3), (3, t0, 4), (4, t0, None), (5, None, 1)], "id int, at timestamp, n int")
    got = {r.id: (r.state, r.s) for r in sinks.retries(df, "at", "n").select("id", "state", (F.unix_millis("next_at") - F.unix_millis("at")).alias("s")).collect()}
    assert got == {1: ("retry", 5000), 2: ("retry", 20000), 3: ("given up", None), 4: ("retry", 5000), 5: ("retry", None)}
    (tmp_path / "waiting-a").write_text("x")
    assert sinks.claim(spark, str(tmp_path), "a") and not sinks.claim(spark, str(tmp_path), "a") and not sinks.claim(spark, str(tmp_path), "b")
    now = [0.0]
    c = sinks.ResultCache(10, 2, lambda: now[0])
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert c.get("projects/1", make).count() == 3 and c.get("projects/1", make) and len(made) == 1
    now[0] = 11.0
    c.get("projects/1", make)
    c.get("projects/2", make)
    c.get("users", make)
    assert len(made) == 4 and len(c.held) == 2
    c.invalidate("projects")
    assert list(c.held) == ["users"]


def test_jdbc(spark, tmp_path):
    from sizelake.sources import jdbc

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id int, name string")
    jdbc.write_table(df, url, "PARTS", "overwrite")
    got = jdbc.read_table(spark, url, "PARTS", "id", 4)
    assert got.rdd.getNumPartitions() == 4 and sorted(r.name for r in got.where("id >= 48").collect()) == ["n48", "n49"]
    assert jdbc.read_table(spark, url, "PARTS").count() == 50
    jdbc.write_table(df.limit(0), url, "NO_PARTS", "overwrite")
    assert jdbc.read_table(spark, url, "NO_PARTS", "id", 4).count() == 0


def test_review_sheets(spark):
    from sizelake.operators.review_sheets import review_sheets

    t = lambda *rows: [list(r) for r in rows]
    e = [
        ("d", 0, "table", None, t(("Mã PYC", "IT-1"), ("Đơn vị", "A"), ("", "x"))), ("d", 1, "paragraph", "NHẬN XÉT LẦN 2", None),
        ("d", 2, "table", None, t(("STT", "Nhận xét", "Phản hồi"), ("1", "Mục IV.1: Định cỡ\nBổ sung sở cứ trang 3, 12", "ok"), ("", "Định cỡ máy chủ Redis:", ""), ("3", "Công thức không đúng?\n\nTrang 9", None))),
        ("d", 3, "table", None, t(("x", "y"),)), ("e", 0, "table", None, t(("STT", "Nhận xét"), ("1", "Kiểm tra lại mục II.3"))), ("e", 1, "paragraph", None, None),
    ]
    info, labels = review_sheets(spark.createDataFrame(e, "doc_id string, element_index int, kind string, text string, rows array<array<string>>"))
    assert sorted(tuple(r) for r in info.collect()) == [("d", "Mã PYC", "IT-1"), ("d", "Đơn vị", "A")]
    got = [(r.doc_id, r["round"], r.item, r.kind, r.text, r.pages, r.sections, r.lead) for r in labels.orderBy("doc_id", "element_index", "row", "atom").collect()]
    assert got == [
        ("d", 2, "1", "anchor", "Mục IV.1: Định cỡ", [], ["IV.1"], None), ("d", 2, "1", "request", "Bổ sung sở cứ trang 3, 12", [3, 12], [], None), ("d", 2, "2", "lead", "Định cỡ máy chủ Redis:", [], [], None),
        ("d", 2, "3", "request", "Công thức không đúng?", [], [], "Định cỡ máy chủ Redis:"), ("d", 2, "3", "anchor", "Trang 9", [9], [], None), ("e", None, "1", "request", "Kiểm tra lại mục II.3", [], ["II.3"], None),
    ]


def test_first_fit_against_plain(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice("ab"), i, [f"w{r.randrange(9)}" for _ in range(r.randrange(0, 6))] if i % 13 else None) for i in range(150)]
    want = {}
    for g in "ab":
        firsts = []
        for _, i, w in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            s = set(w or [])
            hit = next((o for o, f in firsts if (not s and not f) or (s | f and len(s & f) / len(s | f) >= 0.6)), None)
            if hit is None:
                firsts.append((i, s))
            want[g, i] = i if hit is None else hit
    got = {(x.g, x.o): x["first"] for x in first_fit(spark.createDataFrame(rows, "g string, o int, w array<string>"), "g", "o", "w").collect()}
    assert got == want
