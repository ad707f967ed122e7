"""Rules over reports, mappings, answers and policies on literal rows, and distributed numbering against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import answers, detectors, experiment, graphs, relational, summaries
from ledgerloom.operators import reports as R
from ledgerloom.plans import checks

A, B, CC, D = ("0x" + c * 40 for c in "abcd")
H = "0x" + "1" * 64
REPORT = "report_id long, case_id string, protocol_type string, vulnerability_type string, root_cause string, fund_flow string, incident_date string, victims array<string>, attackers array<string>, loss_assets array<string>"


def reports(spark, *rows):
    base = {"report_id": 1, "case_id": "case_1", "protocol_type": "DEX", "vulnerability_type": "", "root_cause": "", "fund_flow": "", "incident_date": "2022-02-02", "victims": ["Big Vault"], "attackers": [A], "loss_assets": []}
    return spark.createDataFrame([tuple({**base, "report_id": i, **r}.values()) for i, r in enumerate(rows)], REPORT)


def test_incident_types_and_flags(spark):
    df = reports(spark, {"protocol_type": "Cross-Chain BRIDGE", "vulnerability_type": "validator"}, {"root_cause": "leaked Private Key"}, {"vulnerability_type": "price oracle"}, {"vulnerability_type": "Reentrancy"}, {"protocol_type": None, "vulnerability_type": None, "root_cause": None})
    kinds = df.select("report_id", R.incident_type(F.col("protocol_type"), F.col("vulnerability_type"), F.col("root_cause")).alias("k")).orderBy("report_id").collect()
    assert [r.k for r in kinds] == ["bridge_exploit", "key_compromise", "oracle_or_market_manipulation", "smart_contract_exploit", "security_incident"]
    row = df.limit(1).select(R.constraints(F.lit("via Tornado; OFAC")).alias("c"), R.skills(F.lit("bridge, usdc swap, 12,000 addresses"), F.lit(True)).alias("s")).first()
    assert row.c[:3] == list(R.ALWAYS_FORBIDDEN) and len(row.c) == 5
    assert len(row.s) == 3 + 4 and "detect_large_address_fanout_laundering_pattern" in row.s


def test_evidence_falls_back(spark):
    """An address that no source names: attackers in general for the first, sanctions for the first four, nothing after."""
    sol = ["So" + str(i) + "1" * 30 for i in range(1, 7)]
    df = reports(spark, {"attackers": sol, "fund_flow": "Tornado and Blender", "victims": []})
    rows = [("S1", 1, "E", "Lazarus"), ("S2", 2, "D", "hacker ADDRESS"), ("S3", 3, "B", "an SDN entry"), ("S4", 4, "C", "OFAC sanction"), ("S5", 5, "A", f"see {sol[1]}"), ("S6", 6, "D", "a mixer"), ("S7", 7, "C", "A Mixer")]
    sources = spark.createDataFrame([(i, p, g, "", f) for i, p, g, f in rows], "source_id string, pos int, grade string, entity string, finding string")
    got = {r.entity_id: (r.evidence, r.confidence) for r in R.entities(df, sources).collect()}
    assert got[sol[0]] == (["S2", "S4"], "C")  # attackers, grades A to D
    assert got[sol[1]] == (["S5"], "A")  # named
    assert got[sol[2]] == got[sol[3]] == (["S3"], "B")  # sanctions, grades A and B
    assert got[sol[4]] == got[sol[5]] == ([], "U")
    assert got["entity:tornado_cash"] == got["entity:blender_io"] == (["S7"], "C")
    assert {r.entity_id: r.evidence for r in R.entities(df, sources.limit(0)).collect()}[sol[0]] == []


def test_case_documents(spark):
    from ledgerloom.sources.files import case_documents

    full = '{"case_id": "c1", "case_name": "One"}'
    rows = [("cases/a/case.json", full), ("cases/a/run_2.json", "[]"), ("cases/_b/case.json", full), ("cases/xx-c/case.json", full), ("summarized/a/summary.json", '{"case_id": ""}'), ("summarized/a/chain_evidence.json", "no json"), ("summarized/a/case.json", full), ("cases/a/b/case.json", full), ("case.json", full), ("cases/a/notes.json", full), ("cases/d/case.json", None)]
    files = spark.createDataFrame(rows, "path string, content string")
    plain = {r.path: tuple(r)[1:] for r in case_documents(files).collect()}
    assert plain == {"cases/a/case.json": ("cases.case", "case_report_manifest", "a", "c1", "One"), "summarized/a/summary.json": ("summarized.summary", "case_report_summary", "a", None, None), "summarized/a/chain_evidence.json": ("summarized.chain_evidence", "chain_evidence", "a", None, None), "cases/d/case.json": ("cases.case", "case_report_manifest", "d", None, None)}
    assert {r.path for r in case_documents(files, include_runs=True).collect()} - set(plain) == {"cases/a/run_2.json"}


def test_complete_cases(spark):
    """Documents of a case by artifact; a case without one of them is not complete."""
    from ledgerloom.sources.files import complete_cases

    rows = spark.createDataFrame([(3, "a", "summary"), (3, "a", "evidence"), (1, "b", "summary"), (2, "c", "evidence"), (2, "c", "evidence")], "n_stages long, case_dir string, artifact string")
    got = {r.case_dir: (r.n_stages, r.complete) for r in complete_cases(rows, ("summary", "evidence")).collect()}
    assert got == {"a": (3, True), "b": (1, False), "c": (2, False)}


def test_address_roles(spark):
    rows = [("attacker", "service", "cex_deposit"), ("x", "service", "mixer_deposit"), ("bridge", "service", ""), ("router", "service", ""), ("centralized_exchange", "service", None), ("mixer_contract_set", "service", ""), ("x", "contract_or_protocol", ""), (None, "service", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, role string, kind string, pattern string")
    got = [r.r for r in df.select("i", R.address_role(F.col("role"), F.col("kind"), F.col("pattern")).alias("r")).orderBy("i").collect()]
    assert got == ["cex_deposit_address", "mixer_deposit_contract", "bridge_contract", "dex_router", "cex_labeled_address", "mixer_deposit_contract", "protocol_contract", "service_address"]


def test_entities_and_flows(spark):
    sol = "So" + "1" * 31
    df = reports(
        spark,
        {"attackers": [f"first {sol}", f"then {A.upper().replace('0X', '0x')} and {B}"], "fund_flow": f"Bridged 10.5 ETH to {D}. From Tornado Cash 3 ETH. Crypto.com: 1,200 ETH", "loss_assets": ["120 eth", "5 USDC", "all of it"]},
        {"attackers": [f"fake sysvar {sol}"], "root_cause": "mint", "vulnerability_type": "without collateral", "loss_assets": ["7 ETH"], "victims": []},
    )
    sources = spark.createDataFrame([("S01", 1, "B", "Big Vault", "loss"), ("S02", 0, "E", "x", "the victim"), ("S03", 2, "A", "y", f"about {B}")], "source_id string, pos int, grade string, entity string, finding string")
    got = {(r.report_id, r.entity_id): (r.role, r.evidence, r.confidence) for r in R.entities(df, sources).collect()}
    assert got[0, "entity:big_vault"] == ("victim", ["S02", "S01"], "B")
    # Within one entry EVM addresses come before others; the first of all is the initial one.
    assert got[0, sol][0] == "attacker_initial" and got[0, A][0] == got[0, B][0] == "attacker_ethereum_wallet"
    assert got[0, B][1:] == (["S03"], "A") and got[0, A][1:] == ([], "U")
    assert got[0, D][0] == "mentioned_address" and got[0, "entity:tornado_cash"][0] == "mixer_contract_set" and got[0, "entity:cryptocom"][0] == "centralized_exchange"
    assert got[1, sol][0] == "fake_sysvar_account" and (1, "entity:big_vault") not in got
    flows = {(r.report_id, r.edge_id): r for r in R.report_edges(df).collect()}
    theft = flows[0, "edge:theft:eth"]
    assert (theft.src, theft.dst, theft.asset, theft.amount) == ("entity:big_vault", A, "WETH", "120") and (0, "edge:theft:usdc") in flows
    assert flows[0, "edge:cex:cryptocom"].amount == "1,200" and flows[0, "edge:bridge_exit:to_ethereum"].amount == "10.5" and flows[0, "edge:bridge_exit:to_ethereum"].src == sol
    mixed = flows[0, "edge:funding_or_mixing:tornado_cash"]
    assert (mixed.src, mixed.dst, mixed.stage) == ("entity:tornado_cash", A, "funding")
    minted = flows[1, "edge:theft:eth"]
    assert (minted.src, minted.dst, minted.pattern) == ("entity:dex", "entity:attacker_unknown", "fraudulent_uncollateralized_mint")
    assert len(flows) == 6
    assert R.entities(df.limit(0), sources).count() == 0 and R.report_edges(df.limit(0)).count() == 0


def test_mappings_are_judged_and_merged(spark):
    entities = spark.createDataFrame([("entity:m", "service", "mixer", "Mixer One"), ("wallet", "address", "attacker", "Mixer One")], "entity_id string, type string, role string, name string")
    columns = "entity_id string, chain string, address string, address_role string, status string, confidence string, evidence array<string>, from_block long, to_block long"
    declared = spark.createDataFrame(
        [
            ("entity:m", "Ethereum", A.upper().replace("0X", "0x"), None, None, "C", ["s2", "s1", " "], 5, 9),
            ("entity:m", "ethereum", A, None, "reported", "B", ["s1"], 3, 4),
            ("entity:m", "bsc", A, None, "reported", "A", ["s1"], 1, 1),
            ("entity:m", "ethereum", "0x12", None, "reported", "A", ["s1"], 1, 1),
            ("entity:m", "ethereum", B, None, "guessed", "A", ["s1"], 1, 1),
            ("entity:m", "ethereum", B, None, "reported", "A", [""], 1, 1),
            ("wallet", "ethereum", D, None, "reported", "A", ["s1"], 1, 1),
        ],
        columns,
    )
    labels = spark.createDataFrame([(CC, "mixer one", "scan1")], "address string, label string, source_id string")
    matches = spark.createDataFrame([("entity:m", D, "cex_deposit", "B", ["s9"], H.upper(), 77)], "entity_id string, address string, pattern string, confidence string, evidence array<string>, tx_hash string, block_number long")
    judged = R.judged_mappings(R.collected_mappings(entities, declared, labels, matches))
    assert {r.outcome: r["count"] for r in judged.groupBy("outcome").count().collect()} == {"ok": 4, "invalid": 3, "missing_evidence": 1}
    got = {r.address: r for r in R.merged_mappings(judged).collect()}
    assert set(got) == {A, CC, D}
    assert (got[A].evidence, got[A].confidence, got[A].from_block, got[A].to_block, got[A].address_role) == (["s1", "s2"], "B", 3, 9, "mixer_deposit_contract")
    assert (got[CC].status, got[D].address_role, got[D].evidence) == ("source_verified", "cex_deposit_address", [f"local_index:tx:{H}", "s9"])


def test_annotations(spark):
    people = spark.createDataFrame([("1", A, "x", "C", ["s"], ""), ("2", B, "x", "C", None, "own"), ("3", CC, "x", "C", [], "")], "id string, address string, role string, confidence string, evidence array<string>, entity string")
    tags = spark.createDataFrame([(A, "scam", "blue", "n"), (B, "", "blue", "n")], "address string, red_tag string, blue_tag string, name string")
    got = {r.id: (r.role, r.confidence, r.evidence, r.entity) for r in R.annotated_entities(people, tags).collect()}
    assert got == {"1": ("flagged_address", "A", ["s", "scanner_red_tag"], "n"), "2": ("x", "B", ["scanner_blue_tag"], "own"), "3": ("x", "C", [], None)}
    flows = spark.createDataFrame([("1", H, "C", "reported", "ETH"), ("2", "0x2", "C", "reported", "ETH"), ("3", None, "C", "reported", "ETH")], "id string, tx_hash string, confidence string, verification_status string, asset string")
    notes = spark.createDataFrame([(H, True, True, True, True), ("0x2", False, None, True, False)], "tx_hash string, risk boolean, revert boolean, trc20 boolean, trc10 boolean")
    got = {r.id: (r.confidence, r.verification_status, r.asset) for r in R.annotated_edges(flows, notes).collect()}
    assert got == {"1": ("A", "scanner_reverted", "TRC10"), "2": ("C", "scanner_confirmed", "TRC20"), "3": ("C", "reported", "ETH")}


def test_existence_answers(spark):
    texts = [f'{{"exists": true, "transaction_count": 1, "matching_edge_ids": [7, "x"], "matching_tx_hashes": ["{H}"]}}', None, "[]", '{"exists": 1, "transaction_count": -1, "matching_edge_ids": "a", "matching_tx_hashes": null}', '{"exists": false, "transaction_count": 1.5, "matching_edge_ids": [], "matching_tx_hashes": []}']
    rows = answers.existence_answer(spark.createDataFrame(list(enumerate(texts)), "task_id long, answer string")).orderBy("task_id").collect()
    assert rows[0].errors == [] and rows[0].edge_ids == ["7", "x"] and rows[0].n == 1
    assert rows[1].errors == rows[2].errors == ["no_object"]
    assert rows[3].errors == ["count_not_whole", "edge_ids_not_list", "exists_not_boolean", "tx_hashes_not_list"]
    assert rows[4].errors == ["count_not_whole"]


def test_sequential_policies(spark):
    tasks = spark.createDataFrame([(1, A, 9, 9, [], 1, []), (2, A, 1, 1, [A], 1, [B, B])], "task_id long, start_node string, max_steps int, max_edges int, seeds array<string>, top_k int, selected_seeds array<string>")
    states = spark.createDataFrame([(1, "a", A), (1, "b", B), (1, "c", CC), (2, "a", A), (2, "b", B)], "task_id long, state_id string, node string")
    candidates = spark.createDataFrame([(1, "a", "ab", B), (1, "b", "bc", CC), (1, "c", "cd", D), (2, "a", "ab", B)], "task_id long, state_id string, edge_id string, dst string")
    steps = spark.createDataFrame([(1, "a", A.upper(), ["ab"]), (1, "b", B, ["bc"]), (1, "c", CC, []), (2, "a", B, []), (2, "a", B, []), (2, "z", A, [])], "task_id long, state_id string, node string, selected array<string>")
    decided = [(1, "a", "ab", "follow", 1.0), (1, "b", "bc", "follow", 1.0), (1, "c", "cd", "ignore", 0.0), (2, "a", "ab", "follow", 1.0), (2, "a", "zz", "ignore", 0.0)]
    decisions = spark.createDataFrame([(*d, 0.0, 0.0, 1 - d[4]) for d in decided], "task_id long, state_id string, edge_id string, action string, p_follow double, p_inspect double, p_stop double, p_ignore double")
    got = {r.task_id: r for r in answers.sequential_errors(tasks, states, candidates, steps, decisions, relational.kept).collect()}
    assert got[1].errors == [] and (got[1].n_steps, got[1].n_unreached) == (3, 0)
    assert set(got[2].errors) == {"unknown_state", "state_twice", "state_missing", "wrong_node", "edge_unknown", "selected", "not_reached", "too_many_steps", "too_many_edges", "unknown_seed", "seed_twice", "too_many_seeds"}


def test_repairs(spark):
    schema = "task_id long, task_type string, decisions array<struct<state: string, action: string>>, errors array<string>"
    original = spark.createDataFrame([(i, t, [("s", "follow")], e) for i, (t, e) in enumerate([("path_completion", ["selected x"]), ("path_completion", ["selected x", "other"]), ("path_completion", ["selected"]), ("transaction_existence", ["selected"]), ("path_completion", []), ("path_completion", ["selected"])])], schema)
    repaired = spark.createDataFrame([(0, "", [("s", "follow")], []), (1, "", [("s", "follow")], []), (2, "", [("s", "stop")], []), (3, "", [("s", "follow")], []), (4, "", [("s", "follow")], [])], schema)
    assert {r.task_id for r in answers.accepted_repairs(original, repaired).collect() if r.accepted} == {0}


def test_detector_registry(spark):
    edges = spark.createDataFrame([("c", A, B, "1", 5.0, 10), ("c", A, CC, "2", 5.0, 20), ("c", B, CC, "3", 5.0, 30)], "case_id string, src string, dst string, edge_id string, amount double, ts long").withColumns({"block_number": F.col("ts"), "token_address": F.lit(None).cast("string"), "asset": F.lit("E"), "edge_type": F.lit(0), "amount": F.col("amount").cast("decimal(18,4)")})
    active = spark.createDataFrame([("c", A)], "case_id string, node string")
    assert {"fifo", "lifo", "tiho", "haircut", "poison"} <= set(detectors.DETECTORS)
    assert {r.edge_id for r in detectors.detect("fifo", edges, active).where("active and action = 'follow'").collect()} == {"1"}
    with pytest.raises(ValueError):
        detectors.detector("fifo")(lambda c, a: c)
    with pytest.raises(ValueError):
        detectors.detect("none", edges, active)


def test_numbering_and_running_sums(spark):
    rng = random.Random(2)
    rows = sorted({(rng.choice("ab" if rng.random() < 0.9 else "c"), rng.randrange(10**6), rng.randrange(5)) for _ in range(3000)})
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, x long, v long").repartition(7)
    numbered = relational.numbered(df, ["k"], ["x", "v"])
    want, seen, total = {}, {}, {}
    for k, x, v in rows:
        seen[k], total[k] = seen.get(k, 0) + 1, total.get(k, 0) + v
        want[k, x, v] = (seen[k], total[k])
    assert {(r.k, r.x, r.v): r.n for r in numbered.collect()} == {key: n for key, (n, _) in want.items()}
    sums = relational.running_sums(numbered.withColumn("w", F.col("v")), ["k"], "n", ["w"], block=100)
    assert {(r.k, r.x, r.v): r.w for r in sums.collect()} == {key: s for key, (_, s) in want.items()}
    assert relational.numbered(df.limit(0), ["k"], ["x"]).count() == 0
    ties = spark.createDataFrame([("a", float(i % 4)) for i in range(40)], "k string, v double")
    n, xs = 40, sorted(i % 4 for i in range(40))
    assert abs(summaries.gini(ties, ["k"], "v").first().gini - (2 * sum((i + 1) * x for i, x in enumerate(xs)) / (n * sum(xs)) - (n + 1) / n)) < 1e-9


def test_corridor_keeps_assets_apart(spark):
    rows = [("c", A, B, "ETH", 5.0), ("c", A, B, "ETH", 2.0), ("c", B, D, "ETH", 1.0), ("c", A, CC, "USD", 9.0), ("c", CC, D, "ETH", 9.0)]
    edges = spark.createDataFrame(rows, "case_id string, src string, dst string, asset string, amount double")
    node = lambda n: spark.createDataFrame([("c", n)], "case_id string, node string")
    got = {(r.src, r.dst): (r.capacity, r.p_follow, r.action) for r in graphs.corridor_scores(edges, node(A), node(D)).collect()}
    assert got == {(A, B): (7.0, 0.99, "follow"), (B, D): (1.0, 0.99, "follow"), (A, CC): (9.0, 0.01, "ignore"), (CC, D): (9.0, 0.01, "ignore")}


def test_ranks_remember_their_symbol(spark):
    rows = [("c", A, B, "X", 1.0), ("c", B, CC, "X", 1.0), ("c", B, D, "Y", 1.0)]
    edges = spark.createDataFrame(rows, "case_id string, src string, dst string, asset string, amount double")
    start = spark.createDataFrame([("c", A)], "case_id string, node string")
    rank = {r.node: r["rank"] for r in graphs.push_rank(edges, start, epsilon=1e-9, symbol="asset").collect()}
    assert abs(rank[CC] / rank[D] - 0.7 / 0.3) < 1e-6 and abs(sum(rank.values()) - 1) < 1e-6
    plain = {r.node: r["rank"] for r in graphs.push_rank(edges, start, epsilon=1e-9).collect()}
    assert abs(plain[CC] - plain[D]) < 1e-9


def test_three_task_run(spark):
    e = [(A, B, "ab", 100.0, 1), (B, CC, "bc", 90.0, 2), (A, D, "ad", 1.0, 3)]
    rows = [(task, *r) for task in ("eac", "pc", "snf") for r in e]
    candidates = spark.createDataFrame(rows, "task_id string, src string, dst string, edge_id string, amount double, ts long").withColumns({"block_number": F.col("ts"), "token_address": F.lit(None).cast("string"), "asset": F.lit("E"), "edge_type": F.lit(0), "amount": F.col("amount").cast("decimal(18,4)")})
    gold = candidates.select("task_id", "edge_id", F.when(F.col("edge_id") == "ad", "ignore").otherwise("follow").alias("gold"))
    tasks = spark.createDataFrame([("eac", "edge_action_classification", A, None), ("pc", "path_completion", A, None), ("snf", experiment.SEEDLESS, None, [A, CC]), ("empty", "path_completion", A, None), ("lost", "path_completion", None, None)], "task_id string, task_type string, start_node string, seeds array<string>")
    candidates = candidates.unionByName(candidates.where("task_id = 'pc'").withColumn("task_id", F.lit("lost")))
    results, stages = experiment.run(tasks, candidates, gold, "poison")
    got = {r.task_id: r for r in results.collect()}
    assert {k: r.status for k, r in got.items()} == {"eac": "completed", "pc": "completed", "snf": "completed", "empty": "failed", "lost": "failed"}
    assert (got["empty"].error, got["lost"].error) == ("no candidates", "no start node")
    assert got["snf"].seeds == [A] and got["pc"].n_paths == 2 and got["pc"].accuracy is not None
    per = {(r.task_id, r.stage): r.n for r in stages.collect()}
    assert len(per) == 15 and per["snf", "node_detection"] == 1 and per["eac", "task_loaded"] == 3 and per["pc", "scoring"] == 3
    cases = lambda *c: spark.createDataFrame([(x,) for x in c], "case_id string")
    assert experiment.leaked_cases(cases("a", "b"), cases("b", "c")).count() == 1


def test_tasks_are_checked(spark):
    tasks = spark.createDataFrame([("1", "path_completion", "a", {"edges": 1}), ("2", checks.DEPRECATED[1], "", {"gold_paths": 1})], "task_id string, task_type string, answer string, context map<string, int>")
    candidates = spark.createDataFrame([("1", "e1"), ("1", "p1"), ("2", "zz")], "task_id string, candidate_id string")
    known = spark.createDataFrame([("e1",), ("p1",)], "candidate_id string")
    assert sorted((r.rule, r.id) for r in checks.task_violations(tasks, candidates, known).collect()) == [("candidate_unknown", "zz"), ("deprecated_type", "2"), ("leak", "2"), ("no_answer", "2")]


def test_long_paths_are_reached(spark):
    n = 60
    edges = spark.createDataFrame([("c", f"n{i}", f"n{i + 1}") for i in range(n)], "case_id string, src string, dst string")
    seen = graphs.reachable(edges, spark.createDataFrame([("c", "n0")], "case_id string, node string"))
    assert {r.node: r.step for r in seen.collect()}[f"n{n}"] == n
