"""Rules over documents: expansion over scopes, look-up with fallback, applicability, missing and ambiguous inputs, checks and
recomputed formulas. No rule instance is lost: each gets a status.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizelake.functions.numbers import relative_difference
from sizelake.rules.compiler import compile_rule, names, number, truth

SYSTEM, SUBSYSTEM, STORAGE = "system", "subsystem", "subsystem_storage"
VALUE = "struct<kind:string,num:double,str:string,bool:boolean>"


@dataclass(frozen=True)
class Input:
    name: str
    required: bool = True
    default: float | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    scope: str = SYSTEM
    severity: str = "major"
    check: str | None = None
    formula: str | None = None
    compare_with: str | None = None
    tolerance: float = 0.0
    applies_when: str | None = None
    inputs: tuple[Input, ...] = ()
    enabled: bool = True
    lookup_missing: bool = False
    round: int = 2
    checklist: tuple[str, ...] = field(default=())

    def blocked(self) -> str | None:
        """Why the rule can't be evaluated at all."""
        if not self.enabled:
            return "disabled"
        if self.lookup_missing:
            return "look-up table missing"
        if not self.check and not self.formula:
            return "no expression"
        if self.formula and not self.compare_with:
            return "nothing to compare with"
        return None


def scopes(rules: list[Rule], subsystems: DataFrame) -> DataFrame:
    """(doc_id, scope_key, rule_ids): each scope once, with the rules that apply to it. A subsystem has one row per storage
    technology; the rules of a kind of scope are an array literal, so that nothing is joined."""
    of = {s: [r.rule_id for r in rules if r.scope == s] for s in (SYSTEM, SUBSYSTEM, STORAGE)}
    docs = subsystems.select("doc_id").distinct().withColumn("scope_key", F.lit(""))
    subs = subsystems.where("name is not null").select("doc_id", F.col("name").alias("scope_key")).distinct()
    store = subsystems.where("name is not null and coalesce(storage, '') <> ''").select("doc_id", F.concat("name", F.lit("/"), "storage").alias("scope_key")).distinct()
    parts = [d.withColumn("rule_ids", F.array(*map(F.lit, of[s]))) for d, s in ((docs, SYSTEM), (subs, SUBSYSTEM), (store, STORAGE)) if of[s]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "scope_key", "rule_ids")


def scope_instances(rules: list[Rule], subsystems: DataFrame) -> DataFrame:
    """(doc_id, rule_id, scope_key): a rule once a document, once a subsystem or once a subsystem with storage."""
    return scopes(rules, subsystems).select("doc_id", F.explode("rule_ids").alias("rule_id"), "scope_key")


def environments(known: DataFrame, params: DataFrame, salts: int = 16) -> DataFrame:
    """known (doc_id, scope_key, ...) with `own` and `doc`: the parameters of the scope and of its document, as maps from name
    to (value, amb). Parameters are gathered once a scope, so that rules join nothing; a scope has as many as it declares.
    The document's map is salted, as one document may have any share of the scopes. Repeated declarations of a name count
    once, the least."""
    p = params.select("doc_id", "scope_key", "name", F.struct("kind", "num", "str", "bool").cast(VALUE).alias("value"), F.coalesce("ambiguous", F.lit(False)).alias("amb")).where("name is not null")
    p = p.groupBy("doc_id", "scope_key", "name").agg(F.min(F.struct("value", "amb")).alias("v"))
    maps = p.groupBy("doc_id", "scope_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("own"))
    doc = maps.where("scope_key = ''").select("doc_id", F.col("own").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = known.join(maps, ["doc_id", "scope_key"], "left").withColumn("salt", F.pmod(F.xxhash64("scope_key"), F.lit(salts)).cast("int"))
    return both.join(doc, ["doc_id", "salt"], "left").drop("salt")


def parameter(name: str) -> Column:
    """(value, amb) of a parameter in the environment: the scope's own, even a null one, before the document's; null if there
    is no value."""
    v = F.when(F.coalesce(F.map_contains_key("own", name), F.lit(False)), F.try_element_at("own", F.lit(name))).otherwise(F.try_element_at("doc", F.lit(name)))
    return F.when(v["value"]["num"].isNotNull() | v["value"]["str"].isNotNull() | v["value"]["bool"].isNotNull(), v)


def evaluate(rules: list[Rule], subsystems: DataFrame, params: DataFrame, constants: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, rule_id, scope_key, severity, status, category, missing, expected, declared, rel_diff), one row per rule
    instance.

    Nulls: a parameter with neither number, text nor truth value is missing; a subsystem without a name has no instance; an
    empty table of subsystems gives no rows. Repeated declarations of a name count once, the least. Order of the gates:
    blocked, applicability (an undefined gate is "not evaluable"), missing, ambiguous, check or formula."""
    constants = constants or {}
    env = environments(scopes(rules, subsystems), params)
    # each parameter is looked up once a scope, and is a column from there on
    asked = {n for r in rules for n in ({i.name for i in r.inputs} | ({r.compare_with} if r.compare_with else set()) | (names(r.applies_when) if r.applies_when else set()) | (names(r.check) if r.check else set()) | (names(r.formula) if r.formula else set()))} - set(constants)
    env = env.select("doc_id", "scope_key", "rule_ids", *[parameter(n).alias(f"__p_{n}") for n in sorted(asked)]).withColumn("rule_id", F.explode("rule_ids"))
    held = lambda n: F.col(f"__p_{n}") if n in asked else F.lit(None).cast(f"struct<value:{VALUE},amb:boolean>")
    status, category, missing, expected, declared, rel = (F.lit(None).cast(x) for x in ("string", "string", "array<string>", "double", "double", "double"))
    severity = F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    for r in reversed(rules):
        defaults = {i.name: i.default for i in r.inputs if i.default is not None}

        def value(n: str, defaults=defaults) -> Column:
            if n in constants:
                return F.struct(F.lit("num").alias("kind"), F.lit(float(constants[n])).alias("num"), none.alias("str"), F.lit(None).cast("boolean").alias("bool"))
            v = held(n)["value"]
            if n in defaults:
                v = F.coalesce(v, F.struct(F.lit("num").alias("kind"), F.lit(float(defaults[n])).alias("num"), none.alias("str"), F.lit(None).cast("boolean").alias("bool")).cast(VALUE))
            return v

        here = F.col("rule_id") == r.rule_id
        why = r.blocked()
        needed = sorted(({i.name for i in r.inputs if i.required and i.default is None} | ({r.compare_with} if r.compare_with else set())) - set(constants))
        lost = F.array_compact(F.array(*[F.when(held(n).isNull(), F.lit(n)) for n in needed])) if needed else F.array().cast("array<string>")
        ambiguous = F.lit(False)
        for n in sorted(({i.name for i in r.inputs} | ({r.compare_with} if r.compare_with else set())) - set(constants)):
            ambiguous = ambiguous | F.coalesce(held(n)["amb"], F.lit(False))
        if why:
            s, c = F.lit("not_evaluable"), F.lit("unverifiable") if r.lookup_missing else none
            e = d = q = F.lit(None).cast("double")
            sev = F.lit("info")
        else:
            e = d = q = F.lit(None).cast("double")
            if r.check:
                ok = truth(compile_rule(r.check, value))
                s1 = F.when(ok.isNull(), "not_evaluable").when(ok, "pass").otherwise("violation")
                c1 = F.when(ok.isNull(), none).when(ok, "pass_with_evidence").otherwise("over_threshold")
            else:
                e, d = number(compile_rule(r.formula, value)), number(compile_rule(r.compare_with, value))
                q = relative_difference(e, d)
                s1 = F.when(q.isNull(), "not_evaluable").when(q <= r.tolerance, "pass").otherwise("violation")
                c1 = F.when(q.isNull(), none).when(q <= r.tolerance, "pass_with_evidence").otherwise("wrong_formula")
            s = F.when(F.size(lost) > 0, "not_evaluable").when(ambiguous, "not_evaluable").otherwise(s1)
            c = F.when(F.size(lost) > 0, "missing_info").when(ambiguous, "unverifiable").otherwise(c1)
            sev = F.when((F.size(lost) > 0) | ambiguous, "minor").when(s1 == "pass", "info").otherwise(r.severity)
            if r.applies_when:
                unknown = names(r.applies_when) - set(constants) - set(defaults)
                gate = truth(compile_rule(r.applies_when, value))
                absent = F.lit(False)
                for n in unknown:
                    absent = absent | held(n).isNull()
                s = F.when(absent | gate.isNull(), "not_evaluable").when(~gate, "not_applicable").otherwise(s)
                c = F.when(absent | gate.isNull() | ~gate, none).otherwise(c)
        status, category, severity = F.when(here, s).otherwise(status), F.when(here, c).otherwise(category), F.when(here, sev).otherwise(severity)
        missing, expected, declared, rel = (F.when(here, new).otherwise(old) for new, old in ((lost, missing), (e, expected), (d, declared), (q, rel)))
    return env.select("doc_id", "rule_id", "scope_key", severity.alias("severity"), status.alias("status"), category.alias("category"), missing.alias("missing"), expected.alias("expected"), declared.alias("declared"), rel.alias("rel_diff"))
