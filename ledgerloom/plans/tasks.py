"""Queries that make tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stable_hash
from ..operators import evidence as E
from ..operators import graphs as G
from ..operators import labelling as L
from ..operators import tasking as K
from ..registry import query
from ..views import Tables
from .joins import reported_pairs
from .labels import LABEL_CTES, outflow_pairs

_PAIRS = f"""{LABEL_CTES}, pc AS (SELECT case_id, src, 'pair:' || substr(sha256('["' || case_id || '", "' || src || '", "' || dst || '"]'), 1, 16) AS candidate_id, min(action) AS action FROM act GROUP BY case_id, src, dst HAVING count(DISTINCT action) = 1)"""
_SETS = f"""{_PAIRS}, n AS (SELECT *, count(*) FILTER (action = 'follow') OVER w AS nf, count(*) FILTER (action = 'stop') OVER w AS ns, count(*) FILTER (action = 'inspect') OVER w AS ni, count(*) FILTER (action = 'ignore') OVER w AS ng, row_number() OVER (PARTITION BY case_id, src, action ORDER BY sha256(candidate_id)) AS place FROM pc WINDOW w AS (PARTITION BY case_id, src)),
 c AS (SELECT *, CASE WHEN ng = 0 THEN least(nf, greatest(2, greatest(1, least(nf, 3)))) ELSE least(nf, greatest(1, least(nf, 3))) END AS cf FROM n),
 k AS (SELECT * FROM c WHERE place <= CASE WHEN action = 'follow' THEN cf WHEN action IN ('stop', 'inspect') THEN 1 ELSE 12 - cf - least(1, ns) - least(1, ni) END),
 st AS (SELECT 'state:' || substr(sha256('["' || case_id || '", "' || src || '"]'), 1, 16) AS state_id, case_id, src AS current_node, list(candidate_id ORDER BY sha256(candidate_id)) AS candidates, list(action ORDER BY sha256(candidate_id)) AS actions FROM k GROUP BY case_id, src HAVING count(*) >= 2 AND count(*) FILTER (action <> 'ignore') > 0)"""


def pairs(t: Tables) -> DataFrame:
    """Candidates of a source with their action; all edges of a pair have the same one, so none is dropped."""
    rows = L.pair_actions(t.dense, outflow_pairs(t), reported_pairs(t), E.attribution(t.ev_entities))
    return rows.withColumn("candidate_id", F.concat(F.lit("pair:"), stable_hash("case_id", "src", "dst")))


def sets(t: Tables) -> DataFrame:
    return K.candidate_sets(pairs(t))


@query("candidate_sets", f"WITH {_SETS} SELECT * FROM st")
def candidate_sets(t: Tables) -> DataFrame:
    return sets(t)


@query("tasks_eac", f"WITH {_SETS} SELECT state_id || ':eac' AS task_id, case_id, current_node, candidates, list_filter(list_transform(range(1, len(candidates) + 1), lambda i: CASE WHEN actions[i] = 'follow' THEN candidates[i] END), lambda x: x IS NOT NULL) AS gold, CAST(least(3, len(candidates)) AS INTEGER) AS top_k, CASE WHEN len(candidates) <= 3 THEN 'easy' WHEN len(candidates) <= 8 THEN 'medium' ELSE 'hard' END AS difficulty FROM st")
def tasks_eac(t: Tables) -> DataFrame:
    return K.edge_tasks(sets(t))


@query("tasks_noise_decoys", f"WITH {_PAIRS}, b AS (SELECT case_id, src, row_number() OVER (PARTITION BY case_id ORDER BY sha256(case_id || '|' || src)) AS rn FROM pc GROUP BY case_id, src HAVING count(*) FILTER (action <> 'ignore') = 0 AND count(*) >= 3), r AS (SELECT pc.*, row_number() OVER (PARTITION BY pc.case_id, pc.src ORDER BY sha256(candidate_id)) AS q FROM pc JOIN b ON b.case_id = pc.case_id AND b.src = pc.src AND b.rn <= 24) SELECT case_id, src, list(candidate_id ORDER BY candidate_id) AS decoys FROM r WHERE q <= 10 GROUP BY ALL")
def tasks_noise_decoys(t: Tables) -> DataFrame:
    return K.noise_decoys(pairs(t))


@query("tasks_noise_seeded", f"WITH {_SETS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sha256(state_id)) AS rn FROM st) SELECT case_id, list(state_id ORDER BY state_id) AS states, coalesce(list(current_node ORDER BY current_node) FILTER (list_contains(actions, 'follow')), []) AS gold_seeds FROM r WHERE rn <= 4 GROUP BY case_id")
def tasks_noise_seeded(t: Tables) -> DataFrame:
    return K.seeded_tasks(sets(t))


@query("tasks_path", """WITH RECURSIVE s AS (SELECT DISTINCT case_id, src AS node FROM ev_edges WHERE stage = 'theft'), p(case_id, start, node, path, seen) AS (SELECT case_id, node, node, CAST([] AS VARCHAR[]), [node] FROM s UNION ALL SELECT p.case_id, p.start, e.dst, list_append(p.path, e.reported_id), list_append(p.seen, e.dst) FROM p JOIN ev_edges e ON e.case_id = p.case_id AND e.src = p.node AND NOT list_contains(p.seen, e.dst) WHERE len(p.path) < 3),
 f AS (SELECT * FROM p WHERE len(path) >= 2 AND (len(path) = 3 OR NOT EXISTS (SELECT 1 FROM ev_edges e WHERE e.case_id = p.case_id AND e.src = p.node AND NOT list_contains(p.seen, e.dst)))) SELECT case_id, start, count(*) AS n_paths, CAST(max(len(path)) AS INTEGER) AS longest FROM f GROUP BY ALL""")
def tasks_path(t: Tables) -> DataFrame:
    from .graph import _edges, _sources

    paths = G.gold_paths(_edges(t), _sources(t)).where(F.size("path") >= 2)
    return paths.groupBy("case_id", "start").agg(F.count("*").alias("n_paths"), F.max(F.size("path")).alias("longest"))


_EXIST = """f AS (SELECT DISTINCT case_id, src, dst, edge_type FROM dense), b AS (SELECT case_id, src, dst, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sha256(concat_ws('|', case_id, src, dst, edge_type))) AS rn FROM f) x WHERE rn <= 8),
 n AS (SELECT case_id, src, dst, 1 - edge_type AS edge_type, 'wrong_type' AS kind FROM b UNION SELECT case_id, dst, src, edge_type, 'reversed' FROM b UNION SELECT b.case_id, b.src, e.dst, b.edge_type, 'same_case' FROM b JOIN b e ON b.case_id = e.case_id AND e.dst <> b.dst AND e.dst <> b.src),
 a AS (SELECT n.* FROM n LEFT JOIN f ON f.case_id = n.case_id AND f.src = n.src AND f.dst = n.dst AND f.edge_type = n.edge_type WHERE f.case_id IS NULL),
 et AS (SELECT case_id, src, dst, edge_type, 'positive' AS kind FROM b UNION ALL SELECT case_id, src, dst, edge_type, kind FROM (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY sha256(concat_ws('|', case_id, src, dst, edge_type))) AS rn FROM a) x WHERE rn <= 4)"""


@query("tasks_existence", f"WITH {_EXIST} SELECT case_id, src, dst, edge_type, kind FROM et")
def tasks_existence(t: Tables) -> DataFrame:
    return K.existence_tasks(t.dense).select("case_id", "src", "dst", "edge_type", "kind")


@query("profile_contract", f"WITH {_SETS} SELECT state_id, CASE WHEN len(candidates) > 6 THEN len(candidates) ELSE 0 END AS tool_calls, CASE WHEN len(candidates) > 6 THEN 'tool_grounded' ELSE 'context_only' END AS profile FROM st")
def profile_contract(t: Tables) -> DataFrame:
    n = F.size("candidates").cast("long")
    return sets(t).select("state_id", F.when(n > 6, n).otherwise(0).alias("tool_calls"), F.when(n > 6, "tool_grounded").otherwise("context_only").alias("profile"))


@query("edge_summary", """SELECT edge_id, src, dst, asset, CAST(amount AS DOUBLE) AS amount, ts, block_number FROM dense""")
def edge_summary(t: Tables) -> DataFrame:
    return t.dense.select("edge_id", "src", "dst", "asset", F.col("amount").cast("double").alias("amount"), "ts", "block_number")
