"""Components against union-find, shares of the splits, keys and edge cases."""

import random

import pytest

from sizelake.llm.related_splits import components, hash_to_min, requester_key, split_dossiers, system_key

COLS = "dossier_id bigint, dossier string, dau_moi_yeu_cau string, component string, node string"


@pytest.mark.parametrize("a, b, same", [
    ("Cấp mới Đồng Hồ Stix 2023 10151", "cap_bo_sung_dong-ho-stix_v2", True), ("Nâng cấp_Zouhu 38323", "ung cuu ZOUHU 2.0.1_2024", True), ("Cấp mới hệ thống Song Lam Den", "Cấp mới Sông Lam Đen_v3_53601", True),
    ("Nâng cấp Moukhi", "Nâng cấp Moukhi Mobile", False), ("Cấp mới Lá Cọ Kail", "Cấp mới Lá Cọ Kai", False),
])
def test_system(a, b, same):
    assert (system_key(a) == system_key(b)) is same


def test_requester():
    assert len({requester_key(x) for x in ("LamTK577", " lamtk577\t", "lamtk577@donvi.test", "lamtk577 (TT Hạ tầng)")}) == 1
    assert {requester_key(x) for x in (None, "", " ", "-", "n/a", "N/A", "chưa có", "không rõ", "(TTCNTT)")} == {None} and system_key(None) is None and system_key("Cấp mới") is None


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(120)}", f"n{r.randrange(120)}") for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)] + [("x", "x"), (None, "y"), ("n1", None)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a and b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in hash_to_min(spark.createDataFrame(edges, "a string, b string"), hot=20, salts=4).collect()}
    assert got == {v: find(v) for v in parent}
    assert hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups_and_edges(spark):
    rows = [(1, "Cấp mới A", "u1", "x", "y"), (1, "Cấp mới A", "u1", "x", "y"), (2, "Nâng cấp a 2024", "u2", None, None), (3, "Cấp mới B", "U2@m.test", "", ""), (4, "Cấp mới C", None, "", ""), (5, None, "-", "", ""), (None, "Cấp mới A", "u1", "", ""), (6, "", "", "", "")]
    got = {r.dossier_id: (r.group_id, r.group_size) for r in components(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 1), 6: (6, 1)}
    assert split_dossiers(spark.createDataFrame([], COLS)).count() == 0


def test_shares(spark):
    r = random.Random(4)
    rows = [(i, f"Cấp mới He{r.randrange(900)}x", f"u{r.randrange(3000)}" if i % 3 else "hot", "", "") for i in range(3000)]
    small = spark.createDataFrame([(i, f"Cấp mới Sys{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "-", "", "") for i in range(4000)], COLS)
    n = {s: c for s, c in split_dossiers(small).groupBy("split").count().collect()}
    assert abs(n["train"] / 4000 - 0.7) < 0.03 and abs(n["test"] / 4000 - 0.15) < 0.03
    s = split_dossiers(spark.createDataFrame(rows, COLS)).collect()
    assert len(s) == 3000 and len({(x.group_id, x.split) for x in s}) == len({x.group_id for x in s})
