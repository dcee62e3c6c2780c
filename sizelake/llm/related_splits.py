"""Problem 2: splits that keep related records together.

Hash-to-min components, held as rows: every node exchanges its neighbour cluster with the cluster's minimum until nothing
changes. Weighted rendezvous hashing assigns components to splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizelake.functions.unicode_forms import fold
from sizelake.session import cut, release

# fixed values: request kinds before a system's name, folded
KINDS = ("cap moi he thong", "cap moi", "cap bo sung", "nang cap", "ung cuu")
# fixed values: entries that name no requester, folded
PLACEHOLDERS = {"", "-", "--", "n/a", "na", "none", "null", "chua co", "khong ro", "khong co", "khong", "?", ".", "tbd", "x", "unknown", "chua ro", "chua xac dinh"}
_TAIL = re.compile(r"^(?:v(?:er(?:sion)?)?\.?)?\d+(?:\.\d+)*$")


def system_key(dossier: str | None) -> str | None:
    """The system's name: without accents, case, separators, the request kind before and version, year, ticket behind."""
    if dossier is None:
        return None
    words = re.sub(r"[\s_\-–—/]+", " ", fold(dossier)).strip()
    for k in KINDS:
        if words == k or words.startswith(k + " "):
            words = words[len(k) :].strip()
            break
    w = words.split()
    while len(w) > 1 and _TAIL.match(w[-1]):
        w.pop()
    return " ".join(w) or None


def requester_key(account: str | None) -> str | None:
    """The account's name: without case, blanks, mail domain and bracketed unit; None for placeholders."""
    if account is None:
        return None
    a = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", fold(account))
    a = re.sub(r"\s+", " ", a).strip()
    if a in PLACEHOLDERS:
        return None
    return re.sub(r"\s", "", a.split("@")[0]) or None


def _udf(f):
    @F.pandas_udf(T.StringType())
    def g(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([f(x if isinstance(x, str) else None) for x in s], dtype=object)

    return g


def keyed(dossiers: DataFrame) -> DataFrame:
    """(dossier_id, key): what each dossier is linked by; s: systems, r: requesters."""
    d = dossiers.select("dossier_id", "dossier", "dau_moi_yeu_cau").where("dossier_id is not null").distinct()
    k = d.select("dossier_id", F.concat(F.lit("s:"), _udf(system_key).asNondeterministic()("dossier")).alias("s"), F.concat(F.lit("r:"), _udf(requester_key).asNondeterministic()("dau_moi_yeu_cau")).alias("r"))
    return k.select("dossier_id", F.explode(F.array("s", "r")).alias("key")).where("key is not null").distinct()


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", salts: int = 32, hot: int = 100_000, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reached through the edges.

    A node's cluster is held as rows (node, member), never as a list, so a cluster of any size is spread over tasks. Each
    round a node sends its cluster to the cluster's minimum and the minimum to every member; the rows of nodes with more
    than `hot` members are salted for the join with their minimum. A round ends in a checkpoint in the shared folder; the
    rounds end when a round changes no row. Nulls on either side are no edge, loops are allowed, repeats count once."""
    if {a, b} - set(edges.columns):
        raise ValueError("edges lack a column")
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
    both = both.unionByName(both.select("v", F.col("v").alias("u"))).distinct()
    c = cut(both)
    shape = _shape(c)
    for _ in range(most_rounds):
        m = c.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))  # combined before the shuffle
        if shape[0] <= hot:  # not even all rows together would make a node hot
            j = c.join(m, "v").select("v", "u", "m")
        else:
            m = m.withColumn("salt", F.explode(F.when(F.col("n") > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
            sized = c.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int"))
            calm = c.join(m.where(F.col("n") <= hot).select("v", "m"), "v")
            busy = sized.join(m.where(F.col("n") > hot).select("v", "salt", "m"), ["v", "salt"]).drop("salt")
            j = calm.select("v", "u", "m").unionByName(busy.select("v", "u", "m"))
        nxt = cut(j.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.*").distinct())
        now = _shape(nxt)
        release(c)  # the next round rests on the new rows only
        c = nxt
        if now == shape:
            break
        shape = now
    else:
        raise RuntimeError(f"not stable after {most_rounds} rounds")
    return c.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")


def _shape(c: DataFrame) -> tuple:
    """The number of rows and the sum of their hashes."""
    return tuple(c.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(dossiers: DataFrame) -> DataFrame:
    """(dossier_id, component, group_id, group_size): every dossier once. A dossier without any key is its own group.

    Links are between keys (a dossier links its system with its requester), so a requester of a third of all dossiers is
    one node, and its dossiers meet it by a join, not by pairs."""
    d = dossiers.select("dossier_id").where("dossier_id is not null").distinct()
    k = cut(keyed(dossiers))  # the keys are read off the names once
    per = k.groupBy("dossier_id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.collect_set("key").alias("all"))
    # a dossier of repeated rows with other spellings may have more than two keys: all are linked with the least
    edges = per.select("a", F.explode("all").alias("b")).distinct()
    comp = hash_to_min(edges)
    of = cut(
        d.join(per.select("dossier_id", F.col("a").alias("node")), "dossier_id", "left")
        .join(comp, "node", "left")
        .select("dossier_id", F.coalesce("component", F.concat(F.lit("d:"), F.col("dossier_id").cast("string"))).alias("component"))
    )
    size = of.groupBy("component").agg(F.min("dossier_id").alias("group_id"), F.count("*").alias("group_size"))
    return of.join(size, "component")


def rendezvous_splits(groups: DataFrame, shares: dict[str, float], seed: str = "1", large: float = 0.002) -> DataFrame:
    """(component, split): the split with the greatest score -weight/ln(hash(component, split)).

    Whole components are assigned, so that shares of records only hold if no component is large. Components above `large`
    of all records (at most 1/large of them, so they may be gathered) are placed first, largest first, where most is
    missing; the weights of the others are what is then missing in each split."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    missing = {s: w * total for s, w in shares.items()}
    placed: dict[str, list[str]] = {s: [] for s in shares}
    for r in groups.where(F.col("group_size") > large * total).orderBy(F.desc("group_size"), "component").collect():
        best = max(missing, key=lambda s: (missing[s] / shares[s], s))
        placed[best].append(r["component"])
        missing[best] -= r["group_size"]
    score = [
        F.struct((-F.lit(max(missing[s], 0.0) + 1e-9) / F.log((F.pmod(F.xxhash64(F.lit(seed), F.lit(s), F.col("component")), F.lit(2**52)) + 0.5) / float(2**52))).alias("score"), F.lit(s).alias("split"))
        for s in sorted(shares)
    ]
    rest = F.array_max(F.array(*score))["split"]
    for s, members in placed.items():
        if members:
            rest = F.when(F.col("component").isin(members), F.lit(s)).otherwise(rest)
    return groups.select("component", "group_size", rest.alias("split"))


SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def split_dossiers(dossiers: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(dossier_id, group_id, split), each dossier once. Rows without dossier_id belong to no record and are passed over; an
    empty table gives an empty one; ties cannot occur, as a hash decides."""
    c = components(dossiers)
    groups = c.groupBy("component").agg(F.first("group_size").alias("group_size"))
    return c.join(rendezvous_splits(groups, shares or SHARES), "component").select("dossier_id", "group_id", "split")


def p2_found(spark, folder: str) -> DataFrame:
    from sizelake.sources.tables import table

    return components(table(spark, folder, "eval_dossiers")).where("group_size > 1").select("dossier_id", "group_id")


def p2_splits(spark, folder: str) -> DataFrame:
    from sizelake.sources.tables import table

    return split_dossiers(table(spark, folder, "eval_dossiers"))
