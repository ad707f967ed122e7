"""Queries of iterative graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import ranking
from ..operators import lookup, policies
from ..operators.relational import kept
from ..registry import query
from ..views import Tables
from .flows import active_sources


def _edges(t: Tables) -> DataFrame:
    return t.ev_edges.withColumnRenamed("reported_id", "edge_id")


def _sources(t: Tables) -> DataFrame:
    return t.ev_edges.where("stage = 'theft'").select("case_id", F.col("src").alias("node")).distinct()


@query("build_subgraph", """WITH RECURSIVE e AS (SELECT DISTINCT case_id, src, dst FROM transfers WHERE status = 'P'), w(case_id, node, hop) AS (SELECT DISTINCT case_id, address, 0 FROM ev_entities UNION SELECT e.case_id, CASE WHEN e.src = w.node THEN e.dst ELSE e.src END, w.hop + 1 FROM w JOIN e ON e.case_id = w.case_id AND (e.src = w.node OR e.dst = w.node) WHERE w.hop < 1), f AS (SELECT case_id, node, min(hop) AS hop FROM w GROUP BY ALL),
 x AS (SELECT t.case_id, t.edge_id, 1 + min(f.hop) AS hop FROM transfers t JOIN f ON f.case_id = t.case_id AND f.node IN (t.src, t.dst) WHERE t.status = 'P' GROUP BY ALL)
 SELECT case_id, edge_id, hop, 'expansion' AS origin FROM x UNION ALL SELECT case_id, edge_id, 1, 'evidence' FROM transfers WHERE status = 'F' AND priority = '1-URGENT' AND asset = 'A'""")
def build_subgraph(t: Tables) -> DataFrame:
    from ..operators.relational import union_priority

    seeds = t.ev_entities.select("case_id", F.col("address").alias("node")).distinct()
    walked = lookup.expand_k_hop(t.transfers.where("status = 'P'"), seeds, k=2).select("case_id", "edge_id", F.col("hop").cast("int").alias("hop"), F.lit("expansion").alias("origin"))
    stated = t.transfers.where("status = 'F' and priority = '1-URGENT' and asset = 'A'").select("case_id", "edge_id", F.lit(1).alias("hop"), F.lit("evidence").alias("origin"))
    return union_priority([(walked, F.col("edge_id")), (stated, F.col("edge_id"))], ["case_id", "edge_id"])


@query("enrich_outgoing", """WITH a AS (SELECT case_id, edge_id, src, edge_type + 1 AS hop FROM dense WHERE priority = '1-URGENT' AND asset = 'A'), s AS (SELECT case_id, src, min(hop) AS hop FROM a GROUP BY ALL), n AS (SELECT d.case_id, d.edge_id, d.src, s.hop, row_number() OVER (PARTITION BY d.case_id, d.src ORDER BY d.block_number, d.edge_id) AS rn FROM dense d JOIN s ON d.case_id = s.case_id AND d.src = s.src)
 SELECT case_id, edge_id, src, hop FROM n WHERE rn <= 10 AND edge_id NOT IN (SELECT edge_id FROM a)""")
def enrich_outgoing(t: Tables) -> DataFrame:
    act = t.dense.where("priority = '1-URGENT' and asset = 'A'").select("case_id", "edge_id", "src", "dst", (F.col("edge_type") + 1).alias("hop"))
    return G.enrich_outgoing(act, t.dense, 10).select("case_id", "edge_id", "src", "hop")


@query("next_hop_chains", """WITH RECURSIVE n AS (SELECT a.case_id, a.reported_id AS e, (SELECT b.reported_id FROM ev_edges b WHERE b.case_id = a.case_id AND b.src = a.dst AND b.ts > a.ts ORDER BY b.ts, b.reported_id LIMIT 1) AS nx FROM ev_edges a), c(case_id, e, pos, len) AS (SELECT case_id, e, e, 0 FROM n UNION ALL SELECT c.case_id, c.e, n.nx, c.len + 1 FROM c JOIN n ON n.case_id = c.case_id AND n.e = c.pos WHERE n.nx IS NOT NULL)
 SELECT case_id, e AS edge_id, arg_max(pos, len) AS last_id, CAST(max(len) AS BIGINT) AS length FROM c GROUP BY case_id, e""")
def next_hop_chains(t: Tables) -> DataFrame:
    return G.chains(_edges(t)).withColumnRenamed("end", "last_id")


@query("gold_paths", """WITH RECURSIVE s AS (SELECT DISTINCT case_id, src AS node FROM ev_edges WHERE stage = 'theft'), p(case_id, start, node, path, seen) AS (SELECT case_id, node, node, CAST([] AS VARCHAR[]), [node] FROM s UNION ALL SELECT p.case_id, p.start, e.dst, list_append(p.path, e.reported_id), list_append(p.seen, e.dst) FROM p JOIN ev_edges e ON e.case_id = p.case_id AND e.src = p.node AND NOT list_contains(p.seen, e.dst) WHERE len(p.path) < 3)
 SELECT case_id, start, path FROM p WHERE len(path) > 0 AND (len(path) = 3 OR NOT EXISTS (SELECT 1 FROM ev_edges e WHERE e.case_id = p.case_id AND e.src = p.node AND NOT list_contains(p.seen, e.dst)))""")
def gold_paths(t: Tables) -> DataFrame:
    return G.gold_paths(_edges(t), _sources(t)).where(F.size("path") > 0)


_REACH = """WITH RECURSIVE r(case_id, node) AS (SELECT DISTINCT case_id, src FROM ev_edges WHERE stage = 'theft' UNION SELECT e.case_id, e.dst FROM r JOIN ev_edges e ON e.case_id = r.case_id AND e.src = r.node)"""


@query("reachability_check", f"{_REACH} SELECT case_id, reported_id AS edge_id FROM ev_edges WHERE (case_id, src) NOT IN (SELECT (case_id, node) FROM r)")
def reachability_check(t: Tables) -> DataFrame:
    return G.unreachable(_edges(t), _sources(t)).select("case_id", "edge_id")


_BUCKETS = """b AS (SELECT DISTINCT case_id, asset FROM ev_edges), s AS (SELECT DISTINCT case_id, src AS node FROM ev_edges WHERE stage = 'theft'), g AS (SELECT DISTINCT case_id, dst AS node FROM ev_edges WHERE stage = 'cash_out' EXCEPT SELECT case_id, node FROM s),
 r(case_id, asset, node) AS (SELECT case_id, asset, node FROM s JOIN b USING (case_id) UNION SELECT e.case_id, e.asset, e.dst FROM r JOIN ev_edges e ON e.case_id = r.case_id AND e.asset = r.asset AND e.src = r.node),
 k(case_id, asset, node) AS (SELECT case_id, asset, node FROM g JOIN b USING (case_id) UNION SELECT e.case_id, e.asset, e.src FROM k JOIN ev_edges e ON e.case_id = k.case_id AND e.asset = k.asset AND e.dst = k.node)"""


@query(
    "flow_corridor",
    f"WITH RECURSIVE {_BUCKETS} SELECT case_id, asset AS bucket, src, dst, capacity, p_follow, CASE WHEN p_follow > 0.5 THEN 'follow' ELSE 'ignore' END AS action FROM (SELECT case_id, asset, src, dst, sum(amount) AS capacity, CASE WHEN (case_id, asset, src) IN (SELECT (case_id, asset, node) FROM r) AND (case_id, asset, dst) IN (SELECT (case_id, asset, node) FROM k) THEN 0.99 ELSE 0.01 END AS p_follow FROM ev_edges GROUP BY ALL) x",
)
def flow_corridor(t: Tables) -> DataFrame:
    targets = t.ev_edges.where("stage = 'cash_out'").select("case_id", F.col("dst").alias("node"))
    return G.corridor_scores(_edges(t), _sources(t), targets)


@query("beam_rollout")
def beam_rollout(t: Tables) -> DataFrame:
    edges = t.dense.select("case_id", "src", "edge_id", "ts", "block_number", "token_address", "asset", "edge_type", "amount", "dst")
    # Few rows, read by each round: ranked once.
    active = kept(policies.max_outflow_sources(t.dense, 10).select("case_id", F.col("src").alias("node"), "rank"))
    scored = policies.taint(edges, active.drop("rank"), "fifo").withColumnRenamed("score", "p_follow")
    return G.beam_rollout(scored, active.where("rank = 1").drop("rank"))


@query("state_policy_rollout", """WITH RECURSIVE r(case_id, node, d) AS (SELECT DISTINCT case_id, src, 0 FROM ev_edges WHERE stage = 'theft' UNION SELECT e.case_id, e.dst, r.d + 1 FROM r JOIN ev_edges e ON e.case_id = r.case_id AND e.src = r.node WHERE r.d < 3) SELECT case_id, node, min(d) AS depth FROM r GROUP BY case_id, node""")
def state_policy_rollout(t: Tables) -> DataFrame:
    return G.state_rollout(_edges(t), _sources(t), 3)


@query("dense_peel")
def dense_peel(t: Tables) -> DataFrame:
    return G.dense_peel(t.dense)


@query("push_rank")
def push_rank(t: Tables) -> DataFrame:
    return G.push_rank(t.dense, active_sources(t, 1), epsilon=1e-4, symbol="asset")



@query(
    "reachability_in_order",
    """WITH RECURSIVE r(case_id, node, t) AS (SELECT DISTINCT case_id, src, CAST(-1 AS BIGINT) FROM ev_edges WHERE stage = 'theft'
 UNION SELECT e.case_id, e.dst, e.ts FROM r JOIN ev_edges e ON e.case_id = r.case_id AND e.src = r.node AND e.ts >= r.t),
 f AS (SELECT case_id, node, min(t) AS t FROM r GROUP BY ALL)
 SELECT e.case_id, e.reported_id AS edge_id FROM ev_edges e LEFT JOIN f ON f.case_id = e.case_id AND f.node = e.src WHERE f.t IS NULL OR e.ts < f.t""",
)
def reachability_in_order(t: Tables) -> DataFrame:
    """Reported edges that no theft leads to through earlier ones; a case's thefts start from where the first of them left."""
    return G.unreached_in_order(_edges(t), _sources(t)).select("case_id", "edge_id")


@query(
    "claimed_chains",
    """WITH RECURSIVE n AS (SELECT a.case_id, a.reported_id AS e, a.ts, (SELECT b.reported_id FROM ev_edges b WHERE b.case_id = a.case_id AND b.src = a.dst AND b.ts > a.ts ORDER BY b.ts, b.reported_id LIMIT 1) AS nx FROM ev_edges a),
 c(case_id, e, start, ts, place) AS (SELECT case_id, e, e, ts, CAST(0 AS BIGINT) FROM n UNION ALL SELECT c.case_id, n.nx, c.start, c.ts, c.place + 1 FROM c JOIN n ON n.case_id = c.case_id AND n.e = c.e WHERE n.nx IS NOT NULL)
 SELECT case_id, e AS edge_id, start AS chain_id, place FROM (SELECT *, row_number() OVER (PARTITION BY case_id, e ORDER BY ts, start) AS rn FROM c) x WHERE rn = 1""",
)
def claimed_chains(t: Tables) -> DataFrame:
    return G.claimed_chains(_edges(t))


def _push_sql(expansions: int, at_once: int, alpha: float = 0.15, epsilon: float = 1e-3, beta: float = 0.7) -> str:
    """CTEs of so many pushes from each case's largest sender; the last one is ``ranks``."""
    rounds = -(-expansions // at_once)
    head = """st AS (SELECT case_id, src, max(amount) AS mx, sum(amount) AS total, count(*) AS n FROM dense GROUP BY ALL),
 s0 AS (SELECT case_id, src AS node, '' AS held, CAST(1 AS DOUBLE) AS residual, CAST(0 AS DOUBLE) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY mx DESC, total DESC, n DESC, src) AS rn FROM st) x WHERE rn = 1),
 fl AS (SELECT case_id, src AS node, dst AS go, asset AS via, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 1 END) AS DOUBLE) AS w FROM dense GROUP BY ALL),
 dg AS (SELECT case_id, node, count(DISTINCT go) AS degree, sum(w) AS total FROM fl GROUP BY ALL), ow AS (SELECT case_id, node, via AS held, sum(w) AS own FROM fl GROUP BY ALL)"""
    parts = [head]
    for k in range(rounds):
        most = min(at_once, expansions - k * at_once)
        same = f"CASE WHEN own >= total THEN 1 ELSE {beta} END"
        share = f"CASE WHEN own IS NULL THEN w / total WHEN held = via THEN ({same}) * w / own ELSE (1 - ({same})) * w / (total - own) END"
        parts.append(
            f"""h{k} AS (SELECT case_id, node FROM (SELECT a.case_id, a.node, row_number() OVER (PARTITION BY a.case_id ORDER BY r DESC, a.node) AS turn FROM (SELECT case_id, node, sum(residual) AS r FROM s{k} GROUP BY ALL) a LEFT JOIN dg ON dg.case_id = a.case_id AND dg.node = a.node WHERE r > 0 AND r > {epsilon} * coalesce(degree, 1)) x WHERE turn <= {most}),
 m{k} AS (SELECT s.*, dg.degree, dg.total, ow.own, h.node IS NOT NULL AS pushes FROM s{k} s LEFT JOIN h{k} h ON h.case_id = s.case_id AND h.node = s.node LEFT JOIN dg ON dg.case_id = s.case_id AND dg.node = s.node LEFT JOIN ow ON ow.case_id = s.case_id AND ow.node = s.node AND ow.held = s.held),
 s{k + 1} AS (SELECT case_id, node, held, sum(residual) AS residual, sum(rank) AS rank FROM (SELECT case_id, node, held, CASE WHEN pushes THEN 0 ELSE residual END AS residual, rank + CASE WHEN NOT pushes THEN 0 WHEN degree IS NULL THEN residual ELSE {alpha} * residual END AS rank FROM m{k}
 UNION ALL SELECT m.case_id, fl.go, fl.via, {1 - alpha} * m.residual * {share}, 0 FROM m{k} m JOIN fl ON fl.case_id = m.case_id AND fl.node = m.node WHERE pushes AND residual > 0) x GROUP BY ALL)"""
        )
    parts.append(f"ranks AS (SELECT case_id, node, sum(rank) AS rank, sum(residual) AS residual FROM s{rounds} GROUP BY ALL)")
    return ", ".join(parts)


#: Pushes of a case, how many go together, and the bound of the community. Rounds are few, so that SQL can write them out.
PUSHES, TOGETHER, PHI = 9, 3, 0.25


@query("best_first_rank", f"WITH {_push_sql(PUSHES, TOGETHER)} SELECT * FROM ranks")
def best_first_rank(t: Tables) -> DataFrame:
    return ranking.best_first_rank(t.dense, active_sources(t, 1), PUSHES, TOGETHER, symbol="asset")


_COMMUNITY = f"""{_push_sql(PUSHES, TOGETHER)}, p AS (SELECT r.case_id, r.node, r.rank, s.node IS NULL AS later, row_number() OVER (PARTITION BY r.case_id ORDER BY s.node IS NULL, r.rank DESC, r.node DESC) AS place FROM ranks r LEFT JOIN s0 s ON s.case_id = r.case_id AND s.node = r.node),
 en AS (SELECT e.case_id, e.dst AS node, min(p.place) AS e FROM (SELECT DISTINCT case_id, src, dst FROM dense WHERE src <> dst) e JOIN p ON p.case_id = e.case_id AND p.node = e.src GROUP BY ALL),
 q AS (SELECT a.case_id, a.node, a.rank, a.place, a.later, (SELECT coalesce(sum(b.rank), 0) FROM p b JOIN en ON en.case_id = b.case_id AND en.node = b.node WHERE b.case_id = a.case_id AND en.e <= a.place AND b.place > a.place) AS boundary, sum(a.rank) OVER (PARTITION BY a.case_id ORDER BY a.place) AS within FROM p a),
 c AS (SELECT *, CASE WHEN within > 0 THEN (CASE WHEN boundary > 1e-12 THEN boundary ELSE 0 END) / within ELSE 'inf'::DOUBLE END AS conductance FROM q),
 z AS (SELECT case_id, coalesce(min(CASE WHEN NOT later OR place <= 65 THEN CASE WHEN conductance < {PHI} THEN place END END), least(65, count(*))) AS last FROM c GROUP BY case_id),
 k AS (SELECT c.case_id, node, rank, CAST(place AS BIGINT) AS place, conductance, place <= last AS inside FROM c JOIN z ON z.case_id = c.case_id)"""


def _community(t: Tables) -> DataFrame:
    sources = active_sources(t, 1)
    ranks = ranking.best_first_rank(t.dense, sources, PUSHES, TOGETHER, symbol="asset")
    return ranking.rank_community(t.dense, ranks, sources, PHI)


@query("conductance_community", f"WITH {_COMMUNITY} SELECT * FROM k")
def conductance_community(t: Tables) -> DataFrame:
    """Communities of each case's largest sender."""
    return _community(t)


@query(
    "community_actions",
    f"""WITH {_COMMUNITY}, e AS (SELECT d.edge_id, d.case_id, coalesce(b.rank, 0) AS r, coalesce(a.inside AND b.inside, false) AS inside FROM dense d LEFT JOIN k a ON a.case_id = d.case_id AND a.node = d.src LEFT JOIN k b ON b.case_id = d.case_id AND b.node = d.dst),
 f AS (SELECT edge_id, inside, CASE WHEN max(r) OVER (PARTITION BY case_id) > 0 THEN r / max(r) OVER (PARTITION BY case_id) ELSE 0 END AS r FROM e)
 SELECT edge_id, p_follow, CASE WHEN p_follow >= 0.5 THEN 'follow' ELSE 'ignore' END AS action FROM (SELECT edge_id, CASE WHEN inside THEN 0.5 + 0.49 * r ELSE 0.49 * r END AS p_follow FROM f) g""",
)
def community_actions(t: Tables) -> DataFrame:
    return ranking.community_actions(t.dense.select("case_id", "edge_id", "src", "dst"), _community(t)).select("edge_id", "p_follow", "action")


def _suspicion_sql() -> str:
    bins = range(ranking.RATING_BINS)
    share = lambda x, total: f"(({x}) + 1e-9) / ({total} + 1e-8)"
    divergence = " + ".join(f"{share(f'b{i}', 'n')} * ln({share(f'b{i}', 'n')} / ({share(f'all_b{i} - b{i}', '(all_n - n)')}))" for i in bins)
    gamma = f"CASE WHEN all_n > n THEN least(n::DOUBLE / (all_n - n), (all_n - n)::DOUBLE / n) * (1 - exp(-greatest(0, {divergence}))) ELSE 0 END"
    score = f"CASE WHEN n > 0 THEN n * pow(2.0, greatest(-12, least(3, n::DOUBLE / all_n + (CASE WHEN all_t > 0 THEN t / all_t ELSE 0 END) + {gamma} - 3))) ELSE 0 END"
    hist = ", ".join(f"count(*) FILTER (bin = {i}) AS {{0}}b{i}" for i in bins)
    names = ["n", "t", *(f"b{i}" for i in bins)]
    filled = ", ".join([*(f"coalesce(i.{c}, 0) AS {c}" for c in names), *(f"coalesce(w.all_{c}, 0) AS all_{c}" for c in names)])
    return f"""x AS (SELECT case_id, src, dst, asset, ts, CASE WHEN amount > 0 THEN amount ELSE 1 END AS amount, ts // 2592000 AS month FROM dense WHERE src <> dst),
 y AS (SELECT case_id, src, dst, (sum(amount) OVER (PARTITION BY case_id, dst, asset, month ORDER BY ts RANGE BETWEEN 172800 PRECEDING AND 172800 FOLLOWING))::DOUBLE / (sum(amount) OVER (PARTITION BY case_id, dst, asset, month))::DOUBLE AS rating FROM x),
 z AS (SELECT case_id, src, dst, rating, least(9, CAST(floor(rating * 10) AS INTEGER)) AS bin FROM y),
 w AS (SELECT case_id, dst AS node, count(*) AS all_n, sum(rating) AS all_t, {hist.format('all_')} FROM z GROUP BY ALL),
 a0 AS (SELECT case_id, src AS node FROM z UNION SELECT case_id, dst FROM z)""" + "".join(
        f""",
 i{p} AS (SELECT z.case_id, z.dst AS node, count(*) AS n, sum(rating) AS t, {hist.format('')} FROM z JOIN a{p} u ON u.case_id = z.case_id AND u.node = z.src JOIN a{p} v ON v.case_id = z.case_id AND v.node = z.dst GROUP BY ALL),
 c{p} AS (SELECT case_id, node, {score} AS score FROM (SELECT a.case_id, a.node, {filled} FROM a{p} a LEFT JOIN w ON w.case_id = a.case_id AND w.node = a.node LEFT JOIN i{p} i ON i.case_id = a.case_id AND i.node = a.node) q),
 p{p} AS (SELECT case_id, {p} AS pass, node, score, avg(score) OVER (PARTITION BY case_id) AS mean, count(*) OVER (PARTITION BY case_id) AS size FROM c{p}),
 a{p + 1} AS (SELECT case_id, node FROM p{p} WHERE score > 1.1 * mean)"""
        for p in range(2)
    )


@query("suspicious_passes", f"WITH {_suspicion_sql()} SELECT * FROM p0 UNION ALL SELECT * FROM p1")
def suspicious_passes(t: Tables) -> DataFrame:
    """The first two passes; SQL writes them out."""
    return ranking.suspicious_passes(ranking.rated_transfers(t.dense), passes=2)


@query("suspicious_set")
def suspicious_set(t: Tables) -> DataFrame:
    return ranking.suspicious_set(ranking.rated_transfers(t.dense, plus=True))
