"""Ranks, communities, sets, chains and reach of graphs against plain sequential versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evidence, graphs, ranking
from ledgerloom.operators import features as W


def graph(spark, rows, case="case_1"):
    """Transfers of (id, src, dst, amount, ts)."""
    return spark.createDataFrame([(case, i, s, d, a, t, "ETH") for i, s, d, a, t in rows], "case_id string, edge_id string, src string, dst string, amount double, ts long, asset string").withColumn("amount", F.col("amount").cast("decimal(18,4)"))


def random_graph(seed, nodes, n, times=20):
    rng = random.Random(seed)
    return [(f"e{i:03}", f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", float(rng.randint(1, 50)), rng.randrange(times)) for i in range(n)]


def nodes_of(spark, *names):
    return spark.createDataFrame([("case_1", n) for n in names], "case_id string, node string")


def sequential_community(rows, ranks, sources, phi, budget):
    """Grows one node at a time, with the boundary worked out anew."""
    out, left = list(sources), set(ranks) - set(sources)

    def conductance():
        edge = {d for _, s, d, *_ in rows if s in out and d not in out}
        inside = sum(ranks.get(n, 0) for n in out)
        return sum(ranks.get(n, 0) for n in edge) / inside if inside > 0 else math.inf

    while left and len(out) < len(sources) + budget and conductance() >= phi:
        best = max(left, key=lambda n: (ranks[n], n))
        out.append(best)
        left.remove(best)
    return set(out)


@pytest.mark.parametrize("seed,phi,budget", [(1, 0.5, 64), (2, 0.2, 64), (3, 1e-3, 64), (4, 1e-3, 3), (5, 2.0, 64)])
def test_rank_community(spark, seed, phi, budget):
    rows, rng = random_graph(seed, 14, 30), random.Random(seed)
    ranks = {f"n{i}": rng.choice([0.0, 0.1, 0.1, rng.random()]) for i in range(14)}
    sources = ["n0", "n3"]
    table = spark.createDataFrame([("case_1", n, r) for n, r in ranks.items()], "case_id string, node string, rank double")
    got = ranking.rank_community(graph(spark, rows), table, nodes_of(spark, *sources), phi, budget)
    own = {r.node for r in got.collect() if r.inside}
    assert own == sequential_community(rows, ranks, sources, phi, budget)
    acts = {r.edge_id: r for r in ranking.community_actions(graph(spark, rows), got).collect()}
    most = max(ranks[d] for _, _, d, *_ in rows)
    for i, s, d, *_ in rows:
        r = ranks[d] / most
        assert acts[i].p_follow == pytest.approx(0.5 + 0.49 * r if s in own and d in own else 0.49 * r)
        assert acts[i].action == ("follow" if acts[i].p_follow >= 0.5 else "ignore")


def test_community_without_rank_or_edges(spark):
    table = spark.createDataFrame([("case_1", "n0", 0.0), ("case_1", "n1", 0.0)], "case_id string, node string, rank double")
    got = ranking.rank_community(graph(spark, [("e", "n0", "n1", 1.0, 1)]), table, nodes_of(spark, "n0"))
    assert {r.node for r in got.collect() if r.inside} == {"n0", "n1"}
    assert ranking.rank_community(graph(spark, [("e", "n0", "n1", 1.0, 1)]), table.where("false"), nodes_of(spark, "n0")).count() == 0


def sequential_push(rows, sources, expansions, alpha=0.15, epsilon=1e-3):
    weights = {}
    for _, s, d, a, _ in rows:
        weights.setdefault(s, {}).setdefault(d, 0.0)
        weights[s][d] += a
    rank, rest = {}, {n: 1 / len(sources) for n in sources}
    for _ in range(expansions):
        hot = [(-r, n) for n, r in rest.items() if r > 0 and r > epsilon * len(weights.get(n, [0]))]
        if not hot:
            break
        minus, n = min(hot)
        r, out = -minus, weights.get(n)
        rest[n] = 0.0
        rank[n] = rank.get(n, 0) + (r if out is None else alpha * r)
        for d, w in (out or {}).items():
            rest[d] = rest.get(d, 0) + (1 - alpha) * r * w / sum(out.values())
    return rank, rest


@pytest.mark.parametrize("seed,expansions", [(1, 1), (2, 6), (3, 12)])
def test_best_first_rank_is_sequential(spark, seed, expansions):
    rows = random_graph(seed, 7, 16)
    rank, rest = sequential_push(rows, ["n0", "n1"], expansions, epsilon=0.01)
    got = {r.node: r for r in ranking.best_first_rank(graph(spark, rows), nodes_of(spark, "n0", "n1"), expansions, epsilon=0.01).collect()}
    assert {n: pytest.approx(r, abs=1e-12) for n, r in rank.items()} == {n: r["rank"] for n, r in got.items() if r["rank"] > 0}
    assert {n: pytest.approx(r, abs=1e-12) for n, r in rest.items() if r} == {n: r.residual for n, r in got.items() if r.residual > 0}
    assert sum(r["rank"] + r.residual for r in got.values()) == pytest.approx(1)


def brute_peel(rows, base, epsilon):
    """All passes over plain lists of transfers (src, dst, bin, temporal)."""
    nodes = {n for s, d, *_ in rows for n in (s, d)}
    alive, history = set(nodes), []

    def hist(part):
        return [sum(1 for *_, b, _ in part if b == i) for i in range(10)]

    def score(n):
        every = [r for r in rows if r[1] == n]
        inside = [r for r in every if r[0] in alive]
        outside = [r for r in every if r[0] not in alive]
        if not inside:
            return 0.0
        total, own = sum(r[3] for r in every), sum(r[3] for r in inside)
        gamma = 0.0
        if outside:
            p = [(x + 1e-9) / (len(inside) + 1e-8) for x in hist(inside)]
            q = [(x + 1e-9) / (len(outside) + 1e-8) for x in hist(outside)]
            kl = sum(x * math.log(x / y) for x, y in zip(p, q))
            gamma = min(len(inside) / len(outside), len(outside) / len(inside)) * (1 - math.exp(-max(0.0, kl)))
        return len(inside) * base ** max(-12, min(3, len(inside) / len(every) + (own / total if total else 0) + gamma - 3))

    while alive:
        scores = {n: score(n) for n in alive}
        mean = sum(scores.values()) / len(scores)
        history.append((mean, scores))
        alive = {n for n in alive if scores[n] > (1 + epsilon) * mean}
    return history


@pytest.mark.parametrize("seed", [1, 2])
def test_suspicious_set(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.randrange(10), rng.random()) for _ in range(60)]
    rows += [("a", "b", 9, 0.9)] * 6 + [("b", "c", 9, 0.8)] * 6 + [("c", "a", 9, 0.7)] * 6
    rows = [r for r in rows if r[0] != r[1]]
    rated = spark.createDataFrame([("case_1", *r) for r in rows], "case_id string, src string, dst string, bin int, temporal double")
    history = brute_peel(rows, 2.0, 0.1)
    got = {}
    for r in ranking.suspicious_passes(rated).collect():
        got.setdefault(r["pass"], {})[r.node] = r.score
    assert len(history) > 1 and len(got) == len(history)
    for p, (_, scores) in enumerate(history):
        assert got[p] == {n: pytest.approx(s) for n, s in scores.items()}
    mean, best = max(history, key=lambda h: h[0])
    found = {r.node: r for r in ranking.suspicious_set(rated).collect()}
    assert {n: r.score for n, r in found.items()} == {n: pytest.approx(s) for n, s in best.items()}
    assert all(r.mean == pytest.approx(mean) and r.share == pytest.approx(r.score / max(best.values())) for r in found.values())


def test_rated_transfers(spark):
    day = 86400
    rows = [("a", "x", "y", 1.0, 10 * day), ("b", "z", "y", 3.0, 11 * day), ("c", "x", "y", 4.0, 20 * day), ("d", "y", "y", 9.0, 10 * day), ("e", "x", "w", 0.0, 10 * day)]
    plain = {r.edge_id: r for r in ranking.rated_transfers(graph(spark, rows)).collect()}
    assert {i: (r.rating, r.bin, r.temporal) for i, r in plain.items()} == {"a": (0.5, 5, 0.5), "b": (0.5, 5, 0.5), "c": (0.5, 5, 0.5), "e": (1.0, 9, 1.0)}
    plus = {r.edge_id: r.temporal for r in ranking.rated_transfers(graph(spark, rows), plus=True).collect()}
    gini = 2 * (1 * 1 + 2 * 3 + 3 * 4) / (3 * 8) - 4 / 3
    assert plus == {"a": pytest.approx(0.5 * (1 + gini) * (1 + 1 / 8)), "b": pytest.approx(0.5 * (1 + gini) * (1 + 2 / 8)), "c": pytest.approx(0.5 * (1 + gini) * (1 + 1 / 8)), "e": pytest.approx(2.0)}


def test_reach_in_order(spark):
    rows = [("late", "a", "b", 1.0, 50), ("early", "b", "c", 1.0, 40), ("after", "b", "d", 1.0, 50), ("far", "c", "d", 1.0, 99), ("back", "d", "b", 1.0, 60)]
    assert graphs.unreachable(graph(spark, rows), nodes_of(spark, "a")).count() == 0
    assert {r.edge_id for r in graphs.unreached_in_order(graph(spark, rows), nodes_of(spark, "a")).collect()} == {"early", "far"}
    got = {r.node: r.arrival for r in graphs.arrivals(graph(spark, rows), nodes_of(spark, "a")).collect()}
    assert got == {"a": None, "b": 50, "d": 50}


@pytest.mark.parametrize("seed", [1, 2])
def test_arrivals_against_relaxing(spark, seed):
    rows = random_graph(seed, 12, 40)
    best = {"n0": -1}
    for _ in rows:
        for _, s, d, _, t in rows:
            if s in best and t >= best[s] and t < best.get(d, 1 << 30):
                best[d] = t
    got = {r.node: -1 if r.arrival is None else r.arrival for r in graphs.arrivals(graph(spark, rows), nodes_of(spark, "n0")).collect()}
    assert got == best


@pytest.mark.parametrize("seed,nodes,n", [(1, 4, 40), (2, 8, 60), (3, 2, 30)])
def test_claimed_chains(spark, seed, nodes, n):
    rows = random_graph(seed, nodes, n, times=100)
    leaving = lambda r: sorted((t, i) for i, s, _, _, t in rows if s == r[2] and t > r[4])
    by, taken, expected = {r[0]: r for r in rows}, set(), {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        at, place = r, 0
        while at is not None and at[0] not in taken:
            taken.add(at[0])
            expected[at[0]] = (r[0], place)
            later = leaving(at)
            at, place = (by[later[0][1]] if later else None), place + 1
    got = {r.edge_id: (r.chain_id, r.place) for r in graphs.claimed_chains(graph(spark, rows)).collect()}
    assert got == expected and len({c for c, _ in got.values()}) > 1


@pytest.mark.parametrize("seed,nodes,n,times", [(1, 3, 50, 8), (2, 6, 60, 20), (3, 1, 12, 3)])
def test_two_hop_paths(spark, seed, nodes, n, times):
    rows = random_graph(seed, nodes, n, times)
    expected = {}
    for i, _, d, _, t in rows:
        near = sorted((u, j) for j, s, _, _, u in rows if s == d and u >= t and j != i)
        if near:
            expected[i] = near[0][1]
    found = evidence.two_hop_paths(graph(spark, rows).repartition(4))
    assert {r.first_edge: r.second_edge for r in found.collect()} == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # what tasks carry over, and no join of edges with edges


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_sequences(spark, seed):
    rng = random.Random(seed)
    rows = [("case_1", f"r{i:03}", f"n{rng.randrange(3)}", rng.choice("abbbbbb"), rng.randrange(30)) for i in range(200)]
    table = spark.createDataFrame(rows, "case_id string, reported_id string, src string, stage string, ts long")
    pairs = []
    for n in sorted({r[2] for r in rows}):
        own = sorted((r[4], r[1], r[3]) for r in rows if r[2] == n)
        pairs += [(x[1], y[1]) for i, x in enumerate(own) for y in own[i + 1 :] if x[2] != y[2]]
    assert {(r.e1, r.e2) for r in evidence.stage_sequences(table, 10).collect()} == set(pairs[:10])
    assert evidence.stage_sequences(table, 5000).count() == len(pairs)


@pytest.mark.parametrize("seed,nodes,n", [(1, 5, 30), (2, 2, 12), (3, 9, 25)])
def test_spread_is_the_line_graph(spark, seed, nodes, n):
    edges = graph(spark, random_graph(seed, nodes, n)).withColumns({"x": F.col("amount").cast("double"), "y": F.col("ts").cast("double")})
    for steps in (1, 2):
        want = {r.edge_id: (r.x, r.y) for r in W.propagate(edges, evidence.line_graph(edges), ["x", "y"], steps).collect()}
        got = {r.edge_id: (r.x, r.y) for r in W.spread(edges, ["x", "y"], steps).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_spread_at_a_hub(spark):
    n = 100_000
    edges = spark.range(n).select(F.lit("case_1").alias("case_id"), F.col("id").cast("string").alias("edge_id"), F.lit("hub").alias("src"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("dst"), F.lit(1.0).alias("x"))
    row = W.spread(edges, ["x"], 2).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    # All edges are neighbours of all: weights of 1 / n, n of them.
    assert row.n == n and row.lo == pytest.approx(1) and row.hi == pytest.approx(1)


def test_read_outs(spark):
    rows = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0), ("a", "3", 6.0), ("a", "4", 4.0), ("b", "5", 3.0)], "case_id string, edge_id string, x double")
    assert {(r.edge_id, r.top_x) for r in W.read_out_top(rows, ["x"]).collect()} == {("1", 4.0), ("2", 4.0), ("3", 4.0), ("4", 4.0), ("5", 3.0)}
    assert {(r.case_id, r.case_x) for r in W.read_out(rows, ["x"], F.avg).collect()} == {("a", 3.25), ("b", 3.0)}
