"""Labels against findings: same dossier, any code, passes excluded, misses kept; and that the query joins something."""

from sizelake.plans import catalog
from sizelake.plans.review import findings, label_hits, labels

FOLDER = "/root/testdata/sf0.001"


def test_small(spark):
    ls = [(1, "A", "x", ["DT-01", "DT-02"]), (2, "B", "x", ["DT-01"]), (3, "A", "y", ["DT-03"]), (4, "A", "y", ["DT-05", "DT-05"]), (5, "C", "y", ["DT-01"]), (6, "A", "y", [])]
    fs = [("A", "DT-01", "missing_info"), ("A", "DT-01", "unverifiable"), ("A", "DT-02", "unverifiable"), ("A", "DT-03", "pass_with_evidence"), ("A", "DT-05", "unverifiable"), ("B", "DT-02", "missing_info")]
    got = label_hits(spark.createDataFrame(ls, "label_id int, dossier string, category string, refs array<string>"), spark.createDataFrame(fs, "doc_id string, rule_ref string, category string"))
    assert {r.label_id: (r.hit, r.hard) for r in got.collect()} == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (False, False)}


def test_query_against_sets(spark):
    found = [r for r in findings(spark, FOLDER).collect() if r.category != "pass_with_evidence"]
    codes, hard = {(r.doc_id, r.rule_ref) for r in found}, {(r.doc_id, r.rule_ref) for r in found if r.category == "missing_info"}
    want = {}
    for x in labels(spark, FOLDER).collect():
        own = {(x.dossier, c) for c in x.refs}
        for k in (x.category, "all"):
            n = want.setdefault(k, [0, 0, 0])
            want[k] = [n[0] + 1, n[1] + bool(own & codes), n[2] + bool(own & hard)]
    got = {r.category: (r.labels, r.hits, r.recall, r.substantive) for r in catalog.QUERIES["label_hit_recall"](spark, FOLDER).collect()}
    assert got == {k: (n, h, round(h / n, 6), round(s / n, 6)) for k, (n, h, s) in want.items()}
    assert 0 < want["all"][2] <= want["all"][1] < want["all"][0]
