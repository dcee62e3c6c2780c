"""Queries over all rows of their tables, not over a part picked by key."""

from collections import Counter

from sizelake.plans import catalog
from sizelake.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_formula_cells(spark):
    want = Counter()
    for x in table(spark, FOLDER, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").collect():
        q, n = int(x.l_quantity), x.l_linenumber
        r = q * n + (20 if x.l_orderkey % 5 == 0 else 0)
        holds = abs(q * n - r) <= max(r * 0.005, 0.5)
        want[x.l_orderkey, n, holds, n == 2 if holds else None] += 1
    got = Counter((r.l_orderkey, r.l_linenumber, r.holds, r.doubled) for r in catalog.QUERIES["formula_cells"](spark, FOLDER).collect())
    assert {k[0] % 3 for k in got} == {0, 1, 2}
    assert got == want


def test_scope_expand_rules(spark):
    names = {x.n_nationkey: x.n_name for x in table(spark, FOLDER, "nation").collect()}
    want = set()
    for x in table(spark, FOLDER, "customer").collect():
        if x.c_nationkey in names:
            want |= {(names[x.c_nationkey], "A-1", ""), (names[x.c_nationkey], "A-2", str(x.c_custkey))}
    got = [(r.doc_id, r.rule_id, r.scope_key) for r in catalog.QUERIES["scope_expand_rules"](spark, FOLDER).collect()]
    assert set(got) == want and len(got) == len(want)
