"""Literal cases of the operators, as small DataFrames."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import evidence, graphs, labelling, lookup, policies, relational, scoring, summaries, tasking
from ledgerloom.operators import features as W
from ledgerloom.sources import files

A, B, D = "0x" + "a" * 40, "0x" + "b" * 40, "0x" + "d" * 40
CC = "0x" + "c" * 40
EDGE = "case_id string, edge_id string, src string, dst string, amount decimal(18,4), ts long, block_number long, token_address string, asset string, edge_type int"


def edges(spark, rows):
    """Rows of (id, src, dst, amount, ts[, token])."""
    full = [("case_1", r[0], r[1], r[2], r[3], r[4], r[4], r[5] if len(r) > 5 else None, "ETH", 0) for r in rows]
    return spark.createDataFrame(full, EDGE.replace("decimal(18,4)", "double")).withColumn("amount", F.col("amount").cast("decimal(18,4)"))


def active(spark, *nodes):
    return spark.createDataFrame([("case_1", n) for n in nodes], "case_id string, node string")


def scores(df, column="score"):
    return {r.edge_id: r[column] for r in df.collect()}


EARLY_LATE = [("early", A, B, 6.0, 10), ("late", A, CC, 4.0, 20)]


@pytest.mark.parametrize("order,want", [("fifo", {"early": "follow", "late": "ignore"}), ("lifo", {"early": "ignore", "late": "follow"}), ("tiho", {"early": "follow", "late": "ignore"})])
def test_taint_orders(spark, order, want):
    got = policies.binary_actions(policies.taint(edges(spark, EARLY_LATE), active(spark, A), order, 0.5))
    assert scores(got, "action") == want
    assert abs(sum(float(r.allocated) for r in got.collect()) - 5.0) < 1e-9


def test_haircut_and_poison(spark):
    e = edges(spark, EARLY_LATE)
    assert scores(policies.constant(e, active(spark, A), 0.5)) == {"early": 0.5, "late": 0.5}
    got = policies.poison_actions(policies.constant(e, active(spark, A), 1.0))
    assert scores(got, "p_follow") == {"early": 1.0, "late": 1.0}
    assert set(scores(policies.poison_actions(policies.constant(e, active(spark, B), 1.0)), "action").values()) == {"ignore"}


def test_budget_by_asset(spark):
    e = edges(spark, [("usdc", A, B, 1000.0, 10, CC), ("eth", A, B, 1.0, 20)])
    assert scores(policies.taint(e, active(spark, A), "fifo", 0.5)) == {"usdc": 0.5, "eth": 0.5}


def test_late_unknown_times_and_zero_amounts(spark):
    e = edges(spark, [("unknown", A, B, 5.0, 0), ("known", A, B, 5.0, 9), ("zero", A, B, 0.0, 99)])
    got = scores(policies.taint(e, active(spark, A), "fifo", 0.5))
    assert got["known"] == 1.0 and got["unknown"] == 0.0 and 0 <= got["zero"] <= 1


def test_max_outflow(spark):
    e = edges(spark, [("1", A, CC, 60.0, 1), ("2", A, CC, 60.0, 2), ("3", B, CC, 100.0, 3)])
    rows = policies.max_outflow_scores(e).orderBy("rank").collect()
    assert [(r.src, float(r.mx)) for r in rows] == [(B, 100.0), (A, 60.0)] and rows[0].probability == 1.0


def test_pair_amounts(spark):
    r = summaries.candidate_amounts(edges(spark, [("1", A, B, 2.5, 5), ("2", A, B, 3.5, 20)])).first()
    assert float(r.amount) == 6.0 and r.comparable and (r.min_ts, r.max_ts) == (5, 20)
    r = summaries.candidate_amounts(edges(spark, [("1", A, B, 100.0, 5, CC), ("2", A, B, 2.0, 20, D)])).first()
    assert float(r.amount) == 0.0 and not r.comparable


def test_seed_ratio_is_finite(spark):
    e = edges(spark, [("1", A, B, 10.0**13, 1)])
    r = summaries.seed_features(e, active(spark, A)).first()
    assert 0 < r.ratio <= 3.4028235e38 and math.isfinite(r.ratio)


def test_k_hop(spark):
    e = edges(spark, [("1", A, B, 1.0, 1), ("2", B, CC, 1.0, 2), ("3", CC, D, 1.0, 3), ("4", D, A, 1.0, 4)])
    got = {r.edge_id: r.hop for r in lookup.expand_k_hop(e, active(spark, A), k=2).collect()}
    assert got == {"1": 1, "4": 1, "2": 2, "3": 2}
    got = {r.edge_id: r.hop for r in lookup.expand_k_hop(e, active(spark, A), k=2, direction="out").collect()}
    assert got == {"1": 1, "2": 2}
    assert lookup.expand_k_hop(e, active(spark, "0x0"), k=4).count() == 0
    assert lookup.expand_k_hop(e, active(spark, A), k=1, max_edges=1).count() == 1


def test_rollout(spark):
    e = edges(spark, [("ab", A, B, 100.0, 1), ("bc", B, CC, 50.0, 2)]).withColumn("p_follow", F.lit(0.9))
    rows = graphs.beam_rollout(e, active(spark, A), depth=3, beam=2).collect()
    assert [(r.path, r.reason) for r in rows] == [(["ab", "bc"], "dead_end")] and abs(rows[0].probability - 0.81) < 1e-9
    assert graphs.beam_rollout(e, active(spark, A), depth=1).first().reason == "budget"
    assert graphs.beam_rollout(e, active(spark, A), threshold=0.95).count() == 0


def test_chains_and_paths(spark):
    e = edges(spark, [("1", A, B, 1.0, 1), ("2", B, CC, 1.0, 2), ("3", CC, A, 1.0, 3), ("4", B, D, 1.0, 1)])
    got = {r.edge_id: (r.end, r.length) for r in graphs.chains(e).collect()}
    assert got == {"1": ("3", 2), "2": ("3", 1), "3": ("3", 0), "4": ("4", 0)}
    paths = sorted(r.path for r in graphs.gold_paths(e, active(spark, A)).collect())
    assert paths == [["1", "2"], ["1", "4"]]
    assert graphs.unreachable(e, active(spark, D)).count() == 4
    assert {r.edge_id for r in graphs.corridor(e, active(spark, A), active(spark, D)).collect()} == {"1", "2", "3", "4"}


def test_ranks_add_up(spark):
    e = edges(spark, [("1", A, B, 3.0, 1), ("2", A, CC, 1.0, 2), ("3", B, D, 1.0, 3), ("4", D, A, 1.0, 4)])
    rows = graphs.push_rank(e, active(spark, A), epsilon=1e-6).collect()
    assert abs(sum(r["rank"] + r.residual for r in rows) - 1) < 1e-6
    rank = {r.node: r["rank"] for r in rows}
    assert rank[B] > rank[D]
    swept = graphs.conductance_sweep(e, graphs.push_rank(e, active(spark, A)).select("case_id", "node", "rank"))
    assert 0 < swept.where("inside").count() <= 4


def test_dense_peel(spark):
    clique = [(f"{i}{j}", f"n{i}", f"n{j}", 100.0, 1) for i in range(5) for j in range(5) if i != j]
    e = edges(spark, clique + [(f"x{i}", "n0", f"y{i}", 1.0, 1) for i in range(20)])
    assert {r.node for r in graphs.dense_peel(e).collect()} == {f"n{i}" for i in range(5)}


def test_labels(spark):
    e = edges(spark, [("1", A, B, 1.0, 1), ("2", B, A, 1.0, 1), ("3", A, CC, 1.0, 1), ("4", D, CC, 1.0, 1)])
    pair = spark.createDataFrame([("case_1", A, B, "r")], "case_id string, src string, dst string, reported_id string")
    none = pair.select("case_id", "src", "dst").limit(0)
    who = spark.createDataFrame([("case_1", B, "mixer", 1)], "case_id string, address string, role string, n_entities long")
    got = {r.edge_id: (r.label, r.action) for r in labelling.label_edges(e, none, pair, active(spark, A), who).collect()}
    assert got == {"1": ("positive", "stop"), "2": ("positive", "follow"), "3": ("hard_negative", "ignore"), "4": ("negative", "ignore")}
    # Pairs of transactions count forwards alone.
    got = {r.edge_id: r.label for r in labelling.label_edges(e, pair.select("case_id", "src", "dst"), pair.limit(0), active(spark, D), who).collect()}
    assert got == {"1": "positive", "2": "negative", "3": "negative", "4": "hard_negative"}


def test_candidate_sets(spark):
    rows = [("case_1", A, f"f{i}", "follow") for i in range(9)] + [("case_1", A, f"i{i}", "ignore") for i in range(20)] + [("case_1", A, "s1", "stop"), ("case_1", A, "s2", "stop"), ("case_1", B, "x", "follow"), ("case_1", CC, "y", "ignore"), ("case_1", CC, "z", "ignore")]
    got = tasking.candidate_sets(spark.createDataFrame(rows, "case_id string, src string, candidate_id string, action string")).collect()
    assert len(got) == 1 and got[0].current_node == A
    n = {a: got[0].actions.count(a) for a in ("follow", "stop", "ignore")}
    assert n == {"follow": 3, "stop": 1, "ignore": 8}


def test_scores(spark):
    rows = spark.createDataFrame([(1, "follow", "follow"), (1, "ignore", "follow"), (1, "stop", "stop")], "k int, p string, g string")
    assert abs(scoring.macro_f1(rows, ["k"], "p", "g").first().macro_f1 - (2 / 3 + 0 + 1) / 3) < 1e-9
    p = spark.createDataFrame([(1, 1.0, 1), (1, 0.05, 0)], "k int, p double, y int")
    assert abs(scoring.ece(p, ["k"], "p", "y").first().ece - 0.025) < 1e-9
    one, two = scoring.precision_recall(F.lit(0), F.lit(0), F.lit(0), 1.0)
    assert spark.range(1).select(one.alias("p"), two.alias("r")).first() == (1.0, 1.0)
    b = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, "follow"), (1.0, 0.0, 0.0, 0.0, None)], "p_follow double, p_inspect double, p_stop double, p_ignore double, gold string")
    assert [r[0] for r in b.select(scoring.brier("gold")).collect()] == [0.0, 1.0]


def test_answers(spark):
    texts = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so {"a": 2} it is',), ("none",), (None,)], "t string")
    assert [r.a.a if r.a else None for r in texts.select(scoring.json_answer("t", "a int").alias("a")).collect()] == [1, 2, None, None]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(C.normalize_address(F.lit("see 0X, " + A.upper().replace("0X", "0x")))) == A and one(C.normalize_address(F.lit("0x12"))) is None
    assert one(C.edge_amount(F.lit(None), F.lit("2000000000000000000"), F.lit(""))) == "2.0"
    assert one(C.edge_amount(F.lit("1.5"), F.lit("9"), F.lit(""))) == "1.5"
    assert one(C.numeric_amount(F.lit("-3"))) == 0.0 and one(C.numeric_amount(F.lit("inf"))) == 0.0 and one(C.numeric_amount(F.lit("3.5"))) == 3.5
    import hashlib
    import json

    assert one(C.stable_hash(F.lit("a"), F.lit("b"))) == hashlib.sha256(json.dumps(["a", "b"]).encode()).hexdigest()[:16]
    assert one(C.normalize_url(F.lit("HTTPS://me@WWW.Example.org:443/a/?utm_source=x&q=1#f"))) == "https://example.org/a?q=1"
    assert one(C.tokens(F.lit("Ab 0xFF 中文字 x"))) == ["ab", "0xff", "中", "文", "字", "中文", "文字"]
    assert one(C.compact_case_id(F.lit("01-2022-Name-2022"))) == "name_2022"
    assert one(C.canonical_edge_id(F.lit("eth:007"))) == "7"
    assert one(C.first_number(F.lit("about 1,234.5 ETH"))) == 1234.5


def test_versions(spark):
    rows = spark.createDataFrame([("c", "x.v3_2"), ("c", "x.v3_10"), ("c", "latest"), ("d", "latest")], "k string, v string")
    assert sorted(r.v for r in files.latest_version(rows, ["k"], "v").collect()) == ["latest", "x.v3_10"]


def test_upsert_and_fallback(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "k int, v string, created_at int")
    new = spark.createDataFrame([(2, "c", 20), (3, "d", 20)], "k int, v string, created_at int")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a", 10), (2, "c", 10), (3, "d", 20)]
    assert sorted(r.v for r in relational.with_fallback(old, new, ["k"]).collect()) == ["a", "b", "d"]


def test_jsonl_quarantine(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert [r.value for r in bad.collect()] == ["not json"]


def test_matches_near_bin_bounds(spark):
    base = [1000.0 * 1.02**i for i in range(30)]
    rep = spark.createDataFrame([("case_1", f"r{i}", A, B, "ETH", x) for i, x in enumerate(base)], "case_id string, reported_id string, src string, dst string, asset string, amount double")
    obs = edges(spark, [(f"e{i}{s}", A, B, x * (1 + s * 0.0099), 1) for i, x in enumerate(base) for s in (-1, 1)])
    got = {(r.reported_id, r.tx_edge) for r in evidence.match_transactions(rep, obs).collect()}
    assert {(f"r{i}", f"e{i}{s}") for i in range(30) for s in (-1, 1)} <= got


def test_windows(spark):
    e = edges(spark, [("1", A, B, 10.0, 86400), ("2", A, B, 30.0, 86400 * 3), ("3", A, B, 60.0, 86400 * 20)])
    got = scores(W.burst_rating(e), "rating")
    assert got == {"1": 0.4, "2": 0.4, "3": 0.6}
    f = W.edge_features(e)
    assert abs(sum(scores(f, "share").values()) - 1) < 1e-9
    spikes = [r.spike for r in W.daily_spikes(e).orderBy("day").collect()]
    assert [round(s, 6) for s in spikes] == [0.1, 0.2, 0.3]


def test_leaks_in_rows(spark):
    """Oracle keys left in a map, a struct or deeper are counted by row."""
    from ledgerloom.plans.checks import count_leaks
    from ledgerloom.plans.scalars import public_view

    rows = spark.sql("""select id, map(if(id = 1, 'gold_paths', 'asset'), 'x') as free, named_struct('a', id, 'own', map(if(id < 3, 'answer', 'b'), 1)) as context,
        if(id = 5, null, array(named_struct('k', 'labels'))) as items from range(6)""")
    assert count_leaks(rows).first() == (3, 6)
    assert count_leaks(public_view(rows.drop("context"))).first() == (0, 6)
    assert count_leaks(rows.drop("context")).first() == (1, 6)
    nested = rows.selectExpr("if(id = 5, null, array(named_struct('labels', id))) as items")
    assert count_leaks(nested).first() == (5, 6)
    assert count_leaks(rows.selectExpr("id as answer")).first() == (6, 6)


def test_pair_actions_as_labels_of_edges_in_one_shuffle(spark):
    """What all edges of a pair are labelled, without a join of edges with evidence."""
    from ledgerloom.operators import evidence, labelling

    n = 400
    edges = spark.range(n).selectExpr("concat('case_', id % 2) as case_id", "concat('e', id) as edge_id", "concat('n', id * 7 % 13) as src", "concat('n', id * 5 % 11) as dst")
    reported = spark.createDataFrame([("case_0", "n1", "n2", "R1"), ("case_0", "n0", "n0", "R2"), ("case_1", "n3", "n4", "R3"), ("case_1", "n99", "n5", "R4")], "case_id string, src string, dst string, reported_id string")
    tx = spark.createDataFrame([("case_0", "n5", "n6"), ("case_1", "n7", "n8")], "case_id string, src string, dst string")
    who = evidence.attribution(spark.createDataFrame([(f"case_{c}", f"n{i}", f"x{i}{j}", ["router", "mixer", "victim"][i % 3]) for c in (0, 1) for i in range(9) for j in range(1 + (i == 4))], "case_id string, address string, entity_id string, role string"))
    seeds = spark.createDataFrame([("case_0", "n1")], "case_id string, node string")
    labels = {r.edge_id: r.action for r in labelling.label_edges(edges, tx, reported, seeds, who).collect()}
    want = {(r.case_id, r.src, r.dst): labels[r.edge_id] for r in edges.collect()}
    pairs = labelling.pair_actions(edges, tx, reported, who)
    got = pairs.collect()
    assert {(r.case_id, r.src, r.dst): r.action for r in got} == want and len(got) == len(want)
    assert len(set(want.values())) > 2


@pytest.mark.parametrize("name", ["candidate_sets", "tasks_eac", "profile_contract"])
def test_candidates_take_one_shuffle_of_edges(spark, name):
    """The wide tables of edges are dealt by source once; before, labels were joined and hashes sorted over six shuffles."""
    import re

    from ledgerloom import registry

    registry.load()
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1
    assert not re.search(r"edge_id|tx_hash", plan) and plan.count("Join LeftOuter") == 1


def test_rollout_reads_all_edges_twice(spark, monkeypatch):
    """Rounds read the edges to follow, which are written once, and not all edges; only those are kept."""
    full = spark.range(300).selectExpr("'c' as case_id", "concat('n', id % 20) as src", "concat('n', id % 17 + 5) as dst", "concat('e', id) as edge_id", "if(id % 20 < 2, 0.9 - id / 1000, 0.1) as p_follow")
    written, kept = [], graphs.kept
    monkeypatch.setattr(graphs, "kept", lambda df: written.append(df) or kept(df))
    rows = graphs.beam_rollout(full, spark.createDataFrame([("c", "n0")], "case_id string, node string"), depth=3).collect()
    assert rows and all(r.reason in ("no_follow", "budget", "dead_end") for r in rows)
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 300") for df in written]
    assert sum(scans) == 2 and written[0].count() == 30


def test_run_with_gold_beside_candidates(spark):
    """A run scores the same whether gold comes as a table or as a column, and joins no edges in the latter case."""
    from ledgerloom.operators import experiment

    e = spark.range(200).selectExpr("concat('t', id % 3) as task_id", "concat('n', id % 5) as src", "concat('n', id % 7) as dst", "concat('e', id) as edge_id", "id as ts", "id as block_number", "cast(null as string) as token_address", "'E' as asset", "0 as edge_type", "cast(id % 9 as decimal(18,4)) as amount")
    gold = e.select("task_id", "edge_id", F.when(F.col("ts") % 4 == 0, "follow").when(F.col("ts") % 4 < 3, "ignore").alias("gold")).where("gold is not null")
    tasks = spark.createDataFrame([("t0", "path_completion", "n1", None), ("t1", experiment.SEEDLESS, None, None), ("t2", "edge_action_classification", "n2", None)], "task_id string, task_type string, start_node string, seeds array<string>")
    out = [experiment.run(tasks, c, g, "fifo") for c, g in ((e, gold), (e.join(gold, ["task_id", "edge_id"], "left"), None))]
    near = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    assert near(out[0][0]) == near(out[1][0]) and near(out[0][1]) == near(out[1][1]) and len(out[0][0].collect()) == 3


def test_pairs_that_have_not_met_are_not_shuffled(spark):
    met = spark.range(2000).selectExpr("concat('c', id % 2) as case_id", "concat('a', id % 37) as address", "concat('a', id * 7 % 53) as dst").distinct()
    asked = met.select("case_id", "address").distinct().where("address < 'a2'").unionByName(spark.createDataFrame([("c0", "new"), ("c9", "a1")], "case_id string, address string"))
    seen = {(r.case_id, r.address, r.dst) for r in met.collect()}
    want = {(r.case_id, r.address, d) for r in asked.collect() for c, d in {(c, d) for c, _, d in seen} if c == r.case_id and d != r.address and (c, r.address, d) not in seen}
    for block in (5, 1024):
        out = lookup.not_met(asked, met, block)
        got = [tuple(r) for r in out.collect()]
        assert set(got) == want and len(got) == len(want) > 100
        # Nothing is dealt anew after the pairs are made.
        assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_linear_fit_reads_written_rows(spark, monkeypatch):
    """A fit reads its rows many times: they are a written table, not the joins that make them."""
    from ledgerloom.plans import learned
    from ledgerloom.views import Tables

    class Seen(Exception):
        pass

    def fit(rows, *_):
        raise Seen(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(learned.M, "fit", fit)
    with pytest.raises(Seen) as seen:
        learned.fit_graph_linear(Tables(spark, "/root/testdata/sf0.001"))
    assert "Join" not in str(seen.value) and "Aggregate" not in str(seen.value)


def test_reached_steps_write_what_each_round_reads(spark):
    from ledgerloom.operators import answers

    n, written = 6, []
    steps = spark.createDataFrame([("t", f"s{i}", f"N{i}", [f"e{i}"]) for i in range(n)], "task_id string, state_id string, node string, selected array<string>")
    candidates = spark.createDataFrame([("t", f"e{i}", f"n{i + 1}") for i in range(n)], "task_id string, edge_id string, dst string")
    seen = answers.reached_steps(steps, candidates, spark.createDataFrame([("t", "n1")], "task_id string, node string"), lambda df: written.append(df) or lookup.kept(df))
    assert sorted(r.state_id for r in seen.collect()) == [f"s{i}" for i in range(1, n)]
    # After the first two tables, rounds read only files.
    assert all("LogicalRDD" not in df._jdf.queryExecution().optimizedPlan().toString() and "LocalRelation" not in df._jdf.queryExecution().optimizedPlan().toString() for df in written[3:])


def test_latest_versions_without_a_join(spark):
    rows = spark.createDataFrame([(1, "x.v2"), (1, "x.v10"), (1, "x.v10"), (2, "x.v3_2"), (2, "x.v3_10"), (3, "latest"), (4, None)], "k int, v string")
    out = files.latest_version(rows, ["k"], "v")
    assert sorted((r.k, r.v or "") for r in out.collect()) == [(1, "x.v10"), (1, "x.v10"), (2, "x.v3_10"), (3, "latest"), (4, "")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
