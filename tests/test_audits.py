"""Each rule of tasks and tool calls broken once, on literal rows."""

import pytest

from ledgerloom.operators import audits

A, B = "0x" + "a" * 40, "0x" + "b" * 40
H = ["0x" + c * 64 for c in "12"]
TASK = "task_id string, case_id string, src string, dst string, chain string, direction string, block_min long, block_max long, edge_types array<int>, n_shown long, profile string, tool_requirement string, required_tools array<string>, public_profile string, found boolean, n_tx long, n_edges long, edge_ids array<string>, tx_hashes array<string>, verified_absent boolean"
GOOD = {"task_id": "t", "case_id": "c", "src": A, "dst": B, "chain": "ethereum", "direction": "out", "block_min": 10, "block_max": 20, "edge_types": [0], "n_shown": 0, "profile": "tool_grounded", "tool_requirement": "required", "required_tools": ["neighbors"], "public_profile": "query_only", "found": True, "n_tx": 2, "n_edges": 2, "edge_ids": ["e2", "e1"], "tx_hashes": H, "verified_absent": None}
NONE = {"found": False, "n_tx": 0, "n_edges": 0, "edge_ids": [], "tx_hashes": [], "verified_absent": True}
TRANSFERS = [("c", "e1", A, B, H[0], 10, 0), ("c", "e2", A, B, H[1].upper().replace("0X", "0x"), 20, 0), ("c", "e3", A, B, H[0], 21, 0), ("c", "e4", A, B, H[0], 15, 1), ("d", "e5", A, B, H[0], 15, 0), ("c", "e6", B, A, H[0], 15, 0), ("c", "e7", A, A, H[0], 15, 0)]


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({}, set()),
        ({"dst": "0x" + "c" * 40, **NONE}, set()),
        ({"chain": None}, {"missing_context", "chain_or_direction"}),
        ({"direction": "in"}, {"chain_or_direction"}),
        ({"src": A.upper().replace("0X", "0x")}, {"src_not_lower"}),
        ({"dst": B.upper().replace("0X", "0x")}, {"dst_not_lower"}),
        ({"block_max": None}, {"missing_context", "no_window", "oracle_found", "oracle_n_tx", "oracle_n_edges", "oracle_edge_ids", "oracle_tx_hashes"}),
        ({"edge_types": []}, {"no_edge_types", "invalid_query"}),
        ({"edge_types": [0, 1]}, {"invalid_query"}),
        ({"src": "somebody"}, {"invalid_query"}),
        ({"n_shown": 1}, {"shows_edges"}),
        ({"profile": "context_only"}, {"not_tool_grounded"}),
        ({"tool_requirement": "optional"}, {"lookup_not_required"}),
        ({"required_tools": ["other"]}, {"lookup_not_required"}),
        ({"required_tools": None}, {"lookup_not_required"}),
        ({"public_profile": None}, {"not_query_only"}),
        ({"found": None}, {"found_not_boolean", "not_verified_absent", "oracle_found"}),
        ({"edge_ids": []}, {"positive_without_oracle", "oracle_edge_ids"}),
        ({"dst": "0x" + "c" * 40, **NONE, "verified_absent": None}, {"not_verified_absent"}),
        (NONE, {"oracle_found", "oracle_n_tx", "oracle_n_edges", "oracle_edge_ids", "oracle_tx_hashes"}),
        ({"n_tx": 3}, {"oracle_n_tx"}),
        ({"n_edges": 1}, {"oracle_n_edges"}),
        ({"edge_ids": ["e1", "e3"]}, {"oracle_edge_ids"}),
        ({"tx_hashes": [H[0]]}, {"oracle_tx_hashes"}),
        ({"block_min": 11}, {"oracle_n_tx", "oracle_n_edges", "oracle_edge_ids", "oracle_tx_hashes"}),
    ],
)
def test_existence_tasks(spark, change, rules):
    tasks = spark.createDataFrame([tuple({**GOOD, **change}.values())], TASK)
    transfers = spark.createDataFrame(TRANSFERS, "case_id string, edge_id string, src string, dst string, tx_hash string, block_number long, edge_type int")
    assert {r.rule for r in audits.existence_violations(tasks, transfers).collect()} == rules


def test_existence_lookup_limit(spark):
    tasks = spark.createDataFrame([tuple(GOOD.values()), tuple({**GOOD, "task_id": "u", **NONE}.values())], TASK)
    transfers = spark.createDataFrame(TRANSFERS, "case_id string, edge_id string, src string, dst string, tx_hash string, block_number long, edge_type int")
    assert {(r.rule, r.id) for r in audits.existence_violations(tasks, transfers, limit=2).collect()} == {("incomplete", "t"), ("incomplete", "u")}
    assert audits.existence_violations(tasks.limit(0), transfers).count() == 0


CONTRACT = ("edge", True, 1, 2, 2)
GROUNDED = ("t", "tool_grounded", ["edge"], ["edge"], "required", "candidate_tool_query", ["a", "b"], ["b", "a"], CONTRACT)
CONTEXT = ("t", "context_only", [], None, "disabled", "graph_context", ["a"], None, None)
PROFILE = "task_id string, profile string, required_tools array<string>, allowed_tools array<string>, tool_requirement string, public_profile string, candidates array<string>, groups array<string>, contract struct<tool: string, with_raw: boolean, per_candidate: int, candidate_count: int, max_calls: int>"


@pytest.mark.parametrize(
    ("row", "at", "value", "rules"),
    [
        (GROUNDED, 0, "t", set()),
        (CONTEXT, 0, "t", set()),
        (GROUNDED, 1, "other", {"unknown_profile"}),
        (GROUNDED, 1, None, {"unknown_profile"}),
        (GROUNDED, 2, ["edge", "graph"], {"grounded_tools"}),
        (GROUNDED, 3, None, {"grounded_tools"}),
        (GROUNDED, 4, "disabled", {"grounded_not_required"}),
        (GROUNDED, 5, None, {"grounded_public_profile"}),
        (GROUNDED, 6, ["a", "b", "c"], {"groups_not_candidates"}),
        (GROUNDED, 7, [], {"groups_not_candidates", "contract", "budget"}),
        (GROUNDED, 8, None, {"contract", "budget"}),
        (GROUNDED, 8, ("edge", True, 1, 2, 3), {"budget"}),
        (GROUNDED, 8, ("edge", None, 1, 2, 2), {"contract"}),
        (GROUNDED, 8, ("edge", True, 1, 3, 2), {"contract"}),
        (CONTEXT, 2, ["edge"], {"context_tools"}),
        (CONTEXT, 4, "required", {"context_requirement"}),
        (CONTEXT, 5, "query_only", {"context_public_profile"}),
    ],
)
def test_profiles(spark, row, at, value, rules):
    row = [*row]
    row[at] = value
    got = audits.profile_violations(spark.createDataFrame([tuple(row)], PROFILE)).collect()
    assert {r.rule for r in got} == rules and all(r.id == "t" for r in got)


GROUPS = [("t", "g1", "eth:1"), ("t", "g1", "2"), ("t", "g2", "eth:002"), ("t", "g3", "3")]
OK = [("edge", "1", "true", "ok"), ("edge", "eth:2", " TRUE ", "ok"), ("edge", "3", "true", "ok")]


@pytest.mark.parametrize(
    ("calls", "answered", "errors", "numbers"),
    [
        (OK, True, [], (3, 3, 3, 1.0, 1.0, 1.0, 0.0, 0.0, 0)),
        ([OK[1], OK[2], ("detector", None, None, "ok")], True, [], (2, 2, 3, 1.0, 1.0, 1.0, 0.0, 0.0, 1)),
        (OK, False, ["invalid_answer"], (3, 3, 3, 1.0, 1.0, 1.0, 0.0, 0.0, 0)),
        ([], True, ["required_missing", "uncovered"], (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)),
        ([*OK, OK[0]], True, ["call_repeated"], (4, 3, 3, 1.0, 1.0, 0.75, 0.25, 0.0, 0)),
        ([*OK, ("edge", "9", "true", "ok")], True, ["call_outside"], (4, 3, 3, 1.0, 1.0, 0.75, 0.25, 0.0, 0)),
        ([*OK, ("edge", "x", "true", "ok"), ("edge", None, "true", "ok")], True, ["call_invalid_edge", "over_budget"], (5, 3, 3, 1.0, 1.0, 0.6, 0.4, 0.0, 0)),
        ([*OK[:2], ("edge", "3", None, "ok")], True, ["call_without_raw", "uncovered"], (3, 2, 2, 2 / 3, 1.0, 2 / 3, 1 / 3, 0.0, 0)),
        ([*OK[:2], ("edge", "3", "true", "error")], True, ["call_failed", "uncovered"], (3, 2, 2, 2 / 3, 1.0, 2 / 3, 1 / 3, 1 / 3, 0)),
        ([*OK, ("graph", None, None, None)], True, ["disallowed"], (4, 3, 3, 1.0, 1.0, 1.0, 0.0, 0.25, 0)),
    ],
)
def test_tracing_protocol(spark, calls, answered, errors, numbers):
    tasks = spark.createDataFrame([("t", ["edge"], ["edge"], 4)], "task_id string, required array<string>, allowed array<string>, max_calls int")
    groups = spark.createDataFrame(GROUPS, "task_id string, candidate_id string, edge_id string")
    made = spark.createDataFrame([("t", i, *c) for i, c in enumerate(calls)], "task_id string, turn int, tool string, edge_id string, with_raw string, status string")
    answers = spark.createDataFrame([("t",)] if answered else [], "task_id string")
    r = audits.tracing_protocol(tasks, groups, made, answers).collect()
    assert len(r) == 1 and r[0].errors == errors
    got = (r[0].n_calls, r[0].n_valid, r[0].covered, r[0].coverage, r[0].required_share, r[0].parameter_accuracy, r[0].unnecessary_share, r[0].error_share, r[0].n_detector)
    assert got == pytest.approx(numbers)
    assert r[0].uncovered == 3 - r[0].covered


def test_existence_audit_meets_transfers_once(spark):
    """Tasks and transfers are joined once by pair; before, six joins carried the tasks, four of them by their ids."""
    from ledgerloom import registry

    registry.load()
    plan = registry.QUERIES["existence_task_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "l_orderkey" not in plan
