"""Queries of windows, policies, ranking, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import padded
from ..operators import features as W
from ..operators import lookup, policies, relational
from ..operators.relational import hash_order, top_n_per_group
from ..registry import query
from ..views import Tables
from .flows import active_sources

_EDGE = "PARTITION BY case_id, src"


@query("edge_features", f"""SELECT edge_id, ln(1 + amount::DOUBLE) AS log_amount, amount::DOUBLE / (sum(amount) OVER ({_EDGE}))::DOUBLE AS share, 1.0 / row_number() OVER ({_EDGE} ORDER BY amount DESC, edge_id) AS amount_rank, 1.0 / row_number() OVER ({_EDGE} ORDER BY ts, block_number, edge_id) AS time_rank, ln(1 + count(*) OVER ({_EDGE})) AS src_degree, ln(1 + count(*) OVER (PARTITION BY case_id, dst)) AS dst_degree, CAST(token_address IS NOT NULL AS INTEGER) AS is_token, CAST(src = dst AS INTEGER) AS is_loop FROM dense""")
def edge_features(t: Tables) -> DataFrame:
    return W.edge_features(t.dense).select("edge_id", "log_amount", "share", "amount_rank", "time_rank", "src_degree", "dst_degree", "is_token", "is_loop")


def _taint_sql(order: str) -> str:
    return f"""WITH s AS (SELECT case_id, src, max(amount) AS mx, sum(amount) AS total, count(*) AS n FROM dense GROUP BY ALL), a AS (SELECT case_id, src FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY mx DESC, total DESC, n DESC, src) AS rn FROM s) x WHERE rn <= 10),
 w AS (SELECT d.edge_id, d.amount, 0.5 * sum(amount) OVER (PARTITION BY d.case_id, d.src, coalesce(token_address, asset)) AS budget, coalesce(sum(amount) OVER (PARTITION BY d.case_id, d.src, coalesce(token_address, asset) ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM dense d JOIN a ON d.case_id = a.case_id AND d.src = a.src),
 r AS (SELECT edge_id, CAST(greatest(0, least(amount, budget - spent)) AS DOUBLE) / CAST(amount AS DOUBLE) AS score FROM w)
 SELECT d.edge_id, coalesce(r.score, 0.0) AS score, CASE WHEN coalesce(r.score, 0) >= 0.5 THEN 'follow' ELSE 'ignore' END AS action FROM dense d LEFT JOIN r USING (edge_id)"""


def _register_taint(name: str, order: str) -> None:
    @query(f"taint_{name}", _taint_sql(order))
    def run(t: Tables) -> DataFrame:
        edges = t.dense.select("case_id", "src", "edge_id", "ts", "block_number", "token_address", "asset", "edge_type", "amount")
        return policies.binary_actions(policies.taint(edges, active_sources(t), name)).select("edge_id", "score", "action")


_register_taint("fifo", "ts, block_number, edge_id")
_register_taint("lifo", "ts DESC, block_number DESC, edge_id DESC")
_register_taint("tiho", "amount DESC, edge_id")

_ACTIVE = "a AS (SELECT case_id, src FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY mx DESC, total DESC, n DESC, src) AS rn FROM (SELECT case_id, src, max(amount) AS mx, sum(amount) AS total, count(*) AS n FROM dense GROUP BY ALL) s) x WHERE rn <= 10)"


@query("taint_poison", f"""WITH {_ACTIVE} SELECT edge_id, CASE WHEN a.src IS NOT NULL THEN 1.0 ELSE 0.0 END AS p_follow, CASE WHEN a.src IS NOT NULL THEN 0.0 ELSE 1.0 END AS p_ignore, CASE WHEN a.src IS NOT NULL THEN 'follow' ELSE 'ignore' END AS action FROM dense d LEFT JOIN a ON d.case_id = a.case_id AND d.src = a.src""")
def taint_poison(t: Tables) -> DataFrame:
    return policies.poison_actions(policies.constant(t.dense, active_sources(t), 1.0)).select("edge_id", "p_follow", "p_ignore", "action")


@query("taint_haircut", f"""WITH {_ACTIVE} SELECT edge_id, CASE WHEN a.src IS NOT NULL THEN 0.5 ELSE 0.0 END AS score, CASE WHEN a.src IS NOT NULL THEN 'follow' ELSE 'ignore' END AS action FROM dense d LEFT JOIN a ON d.case_id = a.case_id AND d.src = a.src""")
def taint_haircut(t: Tables) -> DataFrame:
    return policies.binary_actions(policies.constant(t.dense, active_sources(t), 0.5)).select("edge_id", "score", "action")


_MONTH = "PARTITION BY case_id, dst, asset, ts // 2592000"


@query("burst_rating", f"""SELECT edge_id, (sum(amount) OVER ({_MONTH} ORDER BY ts RANGE BETWEEN 172800 PRECEDING AND 172800 FOLLOWING))::DOUBLE / (sum(amount) OVER ({_MONTH}))::DOUBLE AS rating FROM dense WHERE src <> dst""")
def burst_rating(t: Tables) -> DataFrame:
    return W.burst_rating(t.dense).select("edge_id", "rating")


@query("txspike", """WITH d AS (SELECT case_id, dst, asset, ts // 86400 AS day, sum(amount) AS volume FROM dense GROUP BY ALL) SELECT case_id, dst, asset, day, greatest(0, volume - coalesce(lag(volume) OVER (PARTITION BY case_id, dst, asset ORDER BY day), 0))::DOUBLE / (sum(volume) OVER (PARTITION BY case_id, dst, asset))::DOUBLE AS spike FROM d""")
def txspike(t: Tables) -> DataFrame:
    return W.daily_spikes(t.dense).select("case_id", "dst", "asset", "day", "spike")


def _trail(end: str, name: str, start: str) -> str:
    w = f"(PARTITION BY case_id, {end} ORDER BY ts RANGE BETWEEN {start} AND CURRENT ROW)"
    return f"ln(1 + count(*) OVER {w}) AS {end}_n_{name}, ln(1 + (sum(amount) OVER {w})::DOUBLE) AS {end}_v_{name}"


@query("trailing_windows", "SELECT edge_id, " + ", ".join(_trail(e, n, s) for e in ("src", "dst") for n, s in (("all", "UNBOUNDED PRECEDING"), ("6h", "21600 PRECEDING"), ("48h", "172800 PRECEDING"))) + " FROM dense")
def trailing_windows(t: Tables) -> DataFrame:
    rows = W.trailing(t.dense.select("edge_id", "case_id", "src", "dst", "ts", "amount"))
    return rows.drop("case_id", "src", "dst", "ts", "amount")


@query("intervals", """SELECT case_id, src, avg(gap) AS mean, min(gap) AS least, max(gap) AS most, stddev_pop(gap) AS deviation FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY case_id, src ORDER BY ts, edge_id) AS gap FROM dense) x GROUP BY case_id, src""")
def intervals(t: Tables) -> DataFrame:
    return W.intervals(t.dense, "src")


@query("top_n_per_group", """SELECT case_id, src, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id, src ORDER BY sha256('seed|' || edge_id)) AS rn FROM dense) x WHERE rn <= 5""")
def top_n(t: Tables) -> DataFrame:
    return top_n_per_group(t.dense, ["case_id", "src"], [hash_order(F.lit("seed"), "edge_id")], 5).select("case_id", "src", "edge_id")


@query("latest_version", """SELECT o_custkey, max(o_orderkey % 12) AS major, count(*) AS n FROM (SELECT *, max(o_orderkey % 12) OVER (PARTITION BY o_custkey) AS m FROM orders) x WHERE o_orderkey % 12 = m GROUP BY o_custkey""")
def latest_version(t: Tables) -> DataFrame:
    from ..sources.files import latest_version as latest

    rows = t.orders.select("o_custkey", (F.col("o_orderkey") % 12).alias("major"), F.concat(F.lit("flows.v"), (F.col("o_orderkey") % 12).cast("string")).alias("v"))
    return latest(rows, ["o_custkey"], "v").groupBy("o_custkey").agg(F.max("major").alias("major"), F.count("*").alias("n"))


@query("dedup_keep_first", """SELECT case_id, src, dst, min(edge_id) AS first_edge, max(edge_id) AS last_edge FROM dense GROUP BY ALL""")
def dedup_keep_first(t: Tables) -> DataFrame:
    first = relational.keep_first(t.dense, ["case_id", "src", "dst"], [F.col("edge_id")]).select("case_id", "src", "dst", F.col("edge_id").alias("first_edge"))
    last = relational.keep_first(t.dense, ["case_id", "src", "dst"], [F.desc("edge_id")]).select("case_id", "src", "dst", F.col("edge_id").alias("last_edge"))
    return first.join(last, ["case_id", "src", "dst"])


@query("sequence_ids", """SELECT reported_id, case_id || ':' || lpad(CAST(n AS VARCHAR), greatest(4, length(CAST(n AS VARCHAR)))::INTEGER, '0') || ':' || stage AS qa_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY reported_id) AS n FROM ev_edges) x""")
def sequence_ids(t: Tables) -> DataFrame:
    rows = relational.numbered(t.ev_edges.select("case_id", "reported_id", "stage"), ["case_id"], ["reported_id"])
    return rows.select("reported_id", F.concat_ws(":", "case_id", padded("n", 4), "stage").alias("qa_id"))


@query("temporal_encoding", """WITH x AS (SELECT edge_id, (ts - min(ts) OVER (PARTITION BY case_id)) / (max(ts) OVER (PARTITION BY case_id) - min(ts) OVER (PARTITION BY case_id)) AS t FROM dense) SELECT edge_id, t, """ + ", ".join(f"{n}(t * {f} * pi()) AS {n}{f}" for f in (1, 2, 4, 8) for n in ("sin", "cos")) + " FROM x")
def temporal_encoding(t: Tables) -> DataFrame:
    return W.temporal_encoding(t.dense.select("edge_id", "case_id", "ts")).drop("case_id", "ts")


@query("ranked_metrics", """WITH r AS (SELECT case_id, src, asset = 'A' AS gold, row_number() OVER (PARTITION BY case_id, src ORDER BY amount DESC, edge_id) AS rank FROM dense) SELECT case_id, src, 1.0 / min(CASE WHEN gold THEN rank END) AS mrr, coalesce(min(CASE WHEN gold THEN rank END) <= 1, false) AS hit_1, coalesce(min(CASE WHEN gold THEN rank END) <= 3, false) AS hit_3, coalesce(min(CASE WHEN gold THEN rank END) <= 5, false) AS hit_5 FROM r GROUP BY ALL""")
def ranked_metrics(t: Tables) -> DataFrame:
    return W.ranked_metrics(t.dense.withColumn("gold", F.col("asset") == "A"), ["case_id", "src"], "amount", "gold")


@query("sample_k", """SELECT o_orderkey FROM orders ORDER BY sha256('7|' || CAST(o_orderkey AS VARCHAR)) LIMIT 500""")
def sample_k(t: Tables) -> DataFrame:
    """A sample is the feature here: k rows in a seeded hash order, back in their own order."""
    return t.orders.select("o_orderkey").orderBy(hash_order(F.lit("7"), "o_orderkey")).limit(500).orderBy("o_orderkey")


@query("prevalence_sample", """WITH n AS (SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS p FROM orders), r AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS y, row_number() OVER (PARTITION BY o_orderpriority = '1-URGENT' ORDER BY sha256('s' || chr(31) || CAST(o_orderkey AS VARCHAR))) AS rn FROM orders) SELECT o_orderkey, y FROM r, n WHERE y OR rn <= floor(p * 0.6 / 0.4)""")
def prevalence_sample(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("y"))
    return sampled_to_rate(rows, "y", 0.4, F.sha2(F.concat_ws("\x1f", F.lit("s"), "o_orderkey"), 256))


def sampled_to_rate(rows: DataFrame, label: str, rate: float, order) -> DataFrame:
    """All positives, and negatives in a hash order until positives are the given share.

    Negatives are numbered in a sort over all tasks, so that neither a window nor a limit holds them all.
    """
    marked = rows.withColumn("__h", order)
    n = rows.agg(F.count_if(F.col(label)).alias("__positive"))
    ranked = relational.numbered(marked.where(~F.col(label)).withColumn("__all", F.lit(0)), ["__all"], ["__h"], "__n")
    few = ranked.join(F.broadcast(n)).where(F.col("__n") <= F.floor(F.col("__positive") * (1 - rate) / rate + 1e-9))
    return marked.where(F.col(label)).drop("__h").unionByName(few.drop("__h", "__n", "__all", "__positive"))


@query("select_seeds", """WITH s AS (SELECT case_id, src, max(amount) AS mx, sum(amount) AS total, count(*) AS n FROM dense GROUP BY ALL), p AS (SELECT case_id, src, mx::DOUBLE / (max(mx) OVER (PARTITION BY case_id))::DOUBLE AS p FROM s) SELECT case_id, src FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, src) AS rn FROM p WHERE p >= 0.9) x WHERE rn <= 3""")
def select_seeds(t: Tables) -> DataFrame:
    scored = policies.max_outflow_scores(t.dense).where("probability >= 0.9")
    return top_n_per_group(scored, ["case_id"], [F.desc("probability"), F.col("src")], 3).select("case_id", "src")


@query("limit_and_order", """SELECT edge_id, ts FROM dense ORDER BY ts DESC, edge_id LIMIT 1000""")
def limit_and_order(t: Tables) -> DataFrame:
    return t.dense.select("edge_id", "ts").orderBy(F.desc("ts"), "edge_id").limit(1000)


@query("union_priority", """SELECT edge_id, CASE WHEN edge_type = 0 THEN 'expansion' WHEN status = 'F' THEN 'evidence' ELSE 'neighbour' END AS origin FROM dense WHERE edge_type = 0 OR status = 'F' OR asset = 'N'""")
def union_priority(t: Tables) -> DataFrame:
    part = lambda where, name: (t.dense.where(where).select("edge_id", F.lit(name).alias("origin")), F.col("edge_id"))
    return relational.union_priority([part("edge_type = 0", "expansion"), part("status = 'F'", "evidence"), part("asset = 'N'", "neighbour")], ["edge_id"])


@query("seed_union", """SELECT case_id, node, min(origin) AS origin FROM (SELECT case_id, address AS node, '1-entity' AS origin FROM ev_entities WHERE role = 'attacker_wallet' UNION ALL SELECT case_id, src, '2-reported' FROM ev_edges UNION ALL SELECT case_id, dst, '2-reported' FROM ev_edges) x GROUP BY case_id, node""")
def seed_union(t: Tables) -> DataFrame:
    a = t.ev_entities.where("role = 'attacker_wallet'").select("case_id", F.col("address").alias("node"), F.lit("1-entity").alias("origin"))
    b = t.ev_edges.select("case_id", F.explode(F.array("src", "dst")).alias("node"), F.lit("2-reported").alias("origin"))
    return relational.union_priority([(a, F.col("node")), (b, F.col("node"))], ["case_id", "node"])


@query("non_neighbours", """WITH s AS (SELECT DISTINCT case_id, address FROM ev_entities WHERE role = 'attacker_wallet'), n AS (SELECT DISTINCT case_id, dst FROM dense) SELECT s.case_id, s.address, n.dst FROM s JOIN n ON s.case_id = n.case_id AND s.address <> n.dst WHERE (s.case_id, s.address, n.dst) NOT IN (SELECT (case_id, src, dst) FROM dense)""")
def non_neighbours(t: Tables) -> DataFrame:
    from .joins import seeds

    s = seeds(t).select("case_id", F.col("node").alias("address")).distinct()
    return lookup.not_met(s, t.dense.select("case_id", F.col("src").alias("address"), "dst").distinct())


@query("set_metrics", """SELECT case_id, src, count(DISTINCT dst) FILTER (asset = 'A') AS n_gold, count(DISTINCT dst) FILTER (status = 'F') AS n_found, len(list_intersect(coalesce(list(DISTINCT dst) FILTER (asset = 'A'), []), coalesce(list(DISTINCT dst) FILTER (status = 'F'), []))) AS n_both FROM dense GROUP BY ALL""")
def set_metrics(t: Tables) -> DataFrame:
    gold, found = F.collect_set(F.when(F.col("asset") == "A", F.col("dst"))), F.collect_set(F.when(F.col("status") == "F", F.col("dst")))
    rows = t.dense.groupBy("case_id", "src").agg(gold.alias("g"), found.alias("f"))
    size = lambda c: F.size(c).cast("long")
    return rows.select("case_id", "src", size("g").alias("n_gold"), size("f").alias("n_found"), size(F.array_intersect("g", "f")).alias("n_both"))


@query("case_disjoint_guard", """SELECT DISTINCT case_id FROM ev_entities INTERSECT SELECT DISTINCT case_id FROM ev_edges""")
def case_disjoint_guard(t: Tables) -> DataFrame:
    return t.ev_entities.select("case_id").intersect(t.ev_edges.select("case_id"))


@query("line_graph_propagate", """WITH d AS (SELECT case_id, reported_id AS e, src, dst, ln(1 + amount::DOUBLE) AS x FROM ev_edges), n AS (SELECT case_id, e, src AS n FROM d UNION SELECT case_id, e, dst FROM d), p AS (SELECT DISTINCT a.case_id, a.e AS e1, b.e AS e2 FROM n a JOIN n b ON a.case_id = b.case_id AND a.n = b.n), g AS (SELECT case_id, e1, count(*) AS k FROM p GROUP BY ALL), w AS (SELECT p.case_id, p.e1, p.e2, 1 / sqrt(u.k * v.k) AS weight FROM p JOIN g u ON u.case_id = p.case_id AND u.e1 = p.e1 JOIN g v ON v.case_id = p.case_id AND v.e1 = p.e2),
 x1 AS (SELECT w.case_id, w.e1 AS e, sum(weight * x) AS x FROM w JOIN d ON d.case_id = w.case_id AND d.e = w.e2 GROUP BY ALL), x2 AS (SELECT w.case_id, w.e1 AS e, sum(weight * x) AS x FROM w JOIN x1 ON x1.case_id = w.case_id AND x1.e = w.e2 GROUP BY ALL)
 SELECT e AS edge_id, x AS log_amount, max(x) OVER (PARTITION BY case_id) AS case_log_amount FROM x2""")
def line_graph_propagate(t: Tables) -> DataFrame:
    edges = t.ev_edges.withColumnRenamed("reported_id", "edge_id").withColumn("log_amount", F.log1p(F.col("amount").cast("double")))
    out = W.spread(edges, ["log_amount"], steps=2)
    return W.read_out(out, ["log_amount"]).drop("case_id")


@query(
    "line_graph_read_outs",
    """WITH d AS (SELECT case_id, reported_id AS e, src, dst, ln(1 + amount::DOUBLE) AS x FROM ev_edges), n AS (SELECT case_id, e, src AS n FROM d UNION SELECT case_id, e, dst FROM d), p AS (SELECT DISTINCT a.case_id, a.e AS e1, b.e AS e2 FROM n a JOIN n b ON a.case_id = b.case_id AND a.n = b.n), g AS (SELECT case_id, e1, count(*) AS k FROM p GROUP BY ALL),
 x1 AS (SELECT p.case_id, p.e1 AS e, sum(x / sqrt(u.k * v.k)) AS x FROM p JOIN g u ON u.case_id = p.case_id AND u.e1 = p.e1 JOIN g v ON v.case_id = p.case_id AND v.e1 = p.e2 JOIN d ON d.case_id = p.case_id AND d.e = p.e2 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY x DESC) AS rn FROM x1)
 SELECT case_id, count(*) AS n, max(x) AS case_max, avg(x) AS case_mean, avg(x) FILTER (rn <= 3) AS case_top FROM r GROUP BY case_id""",
)
def line_graph_read_outs(t: Tables) -> DataFrame:
    edges = t.ev_edges.withColumnRenamed("reported_id", "edge_id").withColumn("x", F.log1p(F.col("amount").cast("double")))
    out = W.read_out_top(W.spread(edges, ["x"]), ["x"])
    return out.groupBy("case_id").agg(F.count("*").alias("n"), F.max("x").alias("case_max"), F.avg("x").alias("case_mean"), F.max("top_x").alias("case_top"))


@query("role_fusion", """SELECT edge_id, avg(ln(1 + amount::DOUBLE)) OVER (PARTITION BY case_id) AS case_x, avg(ln(1 + amount::DOUBLE)) OVER (PARTITION BY case_id, src) AS src_x, avg(ln(1 + amount::DOUBLE)) OVER (PARTITION BY case_id, dst) AS dst_x FROM dense""")
def role_fusion(t: Tables) -> DataFrame:
    return W.role_fusion(t.dense.withColumn("x", F.log1p(F.col("amount").cast("double"))), ["x"]).select("edge_id", "case_x", "src_x", "dst_x")


@query("prototype_distance", """WITH x AS (SELECT edge_id, asset, ln(1 + amount::DOUBLE) AS a, ts / 1e9 AS b FROM dense WHERE priority = '1-URGENT'), m AS (SELECT asset AS class, avg(a) AS ma, avg(b) AS mb FROM x GROUP BY asset) SELECT edge_id, class, -sqrt(((a - ma) ** 2 + (b - mb) ** 2) / 2) AS distance FROM x CROSS JOIN m""")
def prototype_distance(t: Tables) -> DataFrame:
    rows = t.dense.where("priority = '1-URGENT'").select("edge_id", "asset", F.log1p(F.col("amount").cast("double")).alias("a"), (F.col("ts") / 1e9).alias("b"))
    return W.prototypes(rows, "asset", ["a", "b"]).select("edge_id", "class", "distance")


@query("predict_actions", """SELECT edge_id, CASE WHEN s >= 0.5 THEN 'follow' ELSE 'ignore' END AS action, s AS p_follow, 1 - s AS p_ignore FROM (SELECT edge_id, (ts % 1000) / 1000.0 AS s FROM dense) x""")
def predict_actions(t: Tables) -> DataFrame:
    return policies.binary_actions(t.dense.select("edge_id", ((F.col("ts") % 1000) / 1000.0).alias("score"))).select("edge_id", "action", "p_follow", "p_ignore")
