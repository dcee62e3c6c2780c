"""Snapshot differences: canonical rows, delivery rules, and edge cases."""

import datetime
import json

from sizelake.operators.snapshot_diff import row_hash, snapshot_changes

COLS = "id string, project_id string, revision_type string, snapshot_content string, created_at timestamp, received_at timestamp, idx int, rows string"
T0 = datetime.datetime(2024, 1, 1)


def rev(i, project, kind, rows, day, got=None, text=None):
    content = text if text is not None else json.dumps({"dinhCoHeThongContent": rows})
    at = T0 + datetime.timedelta(days=day)
    return (i, project, kind, content, at, T0 + datetime.timedelta(days=got if got is not None else day), 1, "x")


def changes(spark, data):
    return sorted(map(tuple, snapshot_changes(spark.createDataFrame(data, COLS)).collect()))


def test_hash_is_canonical():
    a = row_hash({"ma": "A", "cpu": 16, "note": None, "x": [1, {"b": 2.0, "a": None}]})
    assert a == row_hash({"x": [1.0, {"b": 2}], "cpu": 16.0, "ma": "A"})
    assert a != row_hash({"ma": "A", "cpu": "16", "x": [1, {"b": 2}]}) and a != row_hash({"ma": "A", "cpu": 16.5, "x": [1, {"b": 2}]})


def test_changes(spark):
    a, b, c = {"ma": "A", "cpu": 1}, {"ma": "B", "cpu": 2}, {"ma": "C"}
    data = [
        rev("r1", "p", "BASELINE", [a, b], 1), rev("r2", "p", "INCREMENTAL", [a], 2), rev("r3", "p", None, json.dumps([{"cpu": 1.0, "ma": "A"}, {**b, "cpu": 3}, c], indent=2), 3), rev("r4", "p", "BASELINE", [], 4, text='{"dinhCoHeThongContent": "[{'), rev("r5", "p", "BASELINE", None, 5),
        rev("r3", "p", None, [a], 3, got=2), rev("r3", "p", None, [a], 3, got=2), rev("q1", "q", "BASELINE", [a], 1), (None, "p", None, None, None, None, 0, None), ("z", None, "BASELINE", "{}", None, None, 0, None),
    ]
    assert changes(spark, data) == [("r3", "B", "changed"), ("r3", "C", "added"), ("r5", "A", "removed"), ("r5", "B", "removed"), ("r5", "C", "removed")]


def test_ties_and_nulls(spark):
    a, b = {"ma": "A"}, {"ma": "B"}
    data = [rev("r2", "p", "BASELINE", [b], 1), rev("r1", "p", "BASELINE", [a], 1), ("r0", "p", "", json.dumps({"dinhCoHeThongContent": [a, a, {"x": 1}, 5]}), None, None, 0, None)]
    assert changes(spark, data) == [("r2", "A", "removed"), ("r2", "B", "added")]


def test_empty_and_hot(spark):
    assert changes(spark, []) == []
    data = [rev(f"r{k:03d}", "p", "BASELINE", [{"ma": "A", "n": k // 2}], k) for k in range(60)]
    assert len(changes(spark, data)) == 29
