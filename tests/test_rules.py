"""The rule language, the truth table of outcomes, scopes and fallback."""

import pytest
from pyspark.sql import functions as F

from sizelake.rules.compiler import RuleError, compile_rule, names
from sizelake.rules.evaluate import STORAGE, SUBSYSTEM, Input, Rule, evaluate

VALUE = "struct<kind:string,num:double,str:string,bool:boolean>"


def run(spark, text, **env):
    cols = []
    for k, v in env.items():
        cols.append(F.lit(None).cast(VALUE).alias(k) if v is None else F.struct(
            F.lit("x").alias("kind"), F.lit(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None).cast("double").alias("num"),
            F.lit(v if isinstance(v, str) else None).cast("string").alias("str"), F.lit(v if isinstance(v, bool) else None).cast("boolean").alias("bool")).alias(k))
    return spark.range(1).select(*cols).select(compile_rule(text, lambda n: F.col(n)).col.alias("x")).first()[0] if cols else spark.range(1).select(compile_rule(text, None).col.alias("x")).first()[0]


@pytest.mark.parametrize("text, env, want", [
    ("a <= b * 100", {"a": 5, "b": 1}, True), ("1 < a < 3", {"a": 2}, True), ("a / b", {"a": 1, "b": 0}, None), ("a % 2 == 1", {"a": 3}, True), ("a % 3", {"a": -1}, 2.0), ("max(a, b) + ceil(1.2)", {"a": 1, "b": 4}, 6.0),
    ("not flag or a > 1", {"flag": True, "a": 0}, False), ("mode == 'ao_hoa'", {"mode": "ao_hoa"}, True), ("mode == 1", {"mode": "1"}, False), ("mode != 1", {"mode": "1"}, True), ("a > b", {"a": None, "b": 1}, None),
    ("round(2.5)", {}, 2.0), ("abs(-3) - +1", {}, 2.0), ("sqrt(a)", {"a": -1}, None), ("co == (mode == 'x')", {"co": True, "mode": "x"}, True), ("a ** 2", {"a": 3}, 9.0), ("min(a, b)", {"a": None, "b": 1}, None),
])
def test_language(spark, text, env, want):
    assert run(spark, text, **env) == want


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "[1]", "lambda: 1", "f(1)", "a if b else c", "max()", "1 +", "a[0]", "'x' + 1", "a is b", "print(a)"])
def test_refused(text):
    with pytest.raises(RuleError):
        compile_rule(text, lambda n: F.lit(None).cast(VALUE))


def test_names():
    assert names("max(a, b) >= c and mode == 'x'") == {"a", "b", "c", "mode"}


def test_truth_table(spark):
    two = (Input("a"), Input("b"))
    rules = [
        Rule("disabled", check="a > 0", enabled=False), Rule("nothing"), Rule("no_target", formula="a"), Rule("lookup", check="a > 0", lookup_missing=True), Rule("na", check="a > 0", applies_when="a > 100", inputs=two),
        Rule("gate_error", check="a > 0", applies_when="zzz > 1", inputs=two), Rule("missing", check="zzz > 1", inputs=(Input("zzz"),)), Rule("ambiguous", check="amb > 1", inputs=(Input("amb"),)), Rule("ok", check="a < b", inputs=two),
        Rule("bad", check="a > b", inputs=two, severity="critical"), Rule("f_in", formula="a * 2", compare_with="b", tolerance=0.01, inputs=two), Rule("f_out", formula="a * 3", compare_with="b", inputs=two), Rule("zero", formula="zero", compare_with="zero2", inputs=(Input("zero"),)),
        Rule("zero_bad", formula="zero", compare_with="a", inputs=(Input("zero"),)), Rule("undefined", check="a / zero > 1", inputs=(Input("a"), Input("zero"))), Rule("default", check="opt == 7", inputs=(Input("opt", True, 7.0),)), Rule("constant", check="a < limit", inputs=(Input("a"),)),
    ]
    p = [("d", "", n, "num", v, None, None, amb) for n, v, amb in (("a", 1.0, False), ("b", 2.0, False), ("amb", 5.0, True), ("zero", 0.0, None), ("zero2", 0.0, False))] + [("d", "", "null", "num", None, None, None, False), ("d", "", "a", "num", 1.0, None, None, False)]
    params = spark.createDataFrame(p, "doc_id string, scope_key string, name string, kind string, num double, str string, bool boolean, ambiguous boolean")
    subs = spark.createDataFrame([("d", None, None)], "doc_id string, name string, storage string")
    got = {r.rule_id: (r.status, r.category, r.severity) for r in evaluate(rules, subs, params, {"limit": 10}).collect()}
    none = ("not_evaluable", None)
    assert got["disabled"][:2] == none and got["nothing"][:2] == none and got["no_target"][:2] == none and got["gate_error"][:2] == none and got["undefined"][:2] == none
    assert got["lookup"] == ("not_evaluable", "unverifiable", "info") and got["na"][:2] == ("not_applicable", None)
    assert got["missing"] == ("not_evaluable", "missing_info", "minor") and got["ambiguous"] == ("not_evaluable", "unverifiable", "minor")
    assert got["ok"] == ("pass", "pass_with_evidence", "info") and got["bad"] == ("violation", "over_threshold", "critical")
    assert got["f_in"][0] == "pass" and got["f_out"][:2] == ("violation", "wrong_formula") and got["zero"][0] == "pass" and got["zero_bad"][0] == "violation"
    assert got["default"][0] == "pass" and got["constant"][0] == "pass" and len(got) == len(rules)


def test_scopes_and_fallback(spark):
    rules = [Rule("sub", SUBSYSTEM, check="x > 1", inputs=(Input("x"),)), Rule("sto", STORAGE, check="x > 1", inputs=(Input("x"),))]
    subs = spark.createDataFrame([("d", "A", "ssd"), ("d", "A", "hdd"), ("d", "B", ""), ("d", "B", ""), ("e", "A", None)], "doc_id string, name string, storage string")
    p = [("d", "", "x", 5.0), ("d", "B", "x", None), ("d", "A/ssd", "x", 0.0)]
    params = spark.createDataFrame([(a, b, c, "num", v, None, None, False) for a, b, c, v in p], "doc_id string, scope_key string, name string, kind string, num double, str string, bool boolean, ambiguous boolean")
    got = {(r.doc_id, r.rule_id, r.scope_key): r.category or r.status for r in evaluate(rules, subs, params).collect()}
    # a present null hides the document's value; a scope without a value of its own takes it
    assert got == {("d", "sub", "A"): "pass_with_evidence", ("d", "sub", "B"): "missing_info", ("e", "sub", "A"): "missing_info", ("d", "sto", "A/ssd"): "over_threshold", ("d", "sto", "A/hdd"): "pass_with_evidence"}
    assert evaluate(rules, subs.limit(0), params).count() == 0
