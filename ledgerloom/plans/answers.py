"""Queries of checks and scores of stored answers, tool calls and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators.lookup import kept
from ..registry import query
from ..views import Tables
from .scores import _PRED, predictions

_HASH = "concat('0x', lpad(lower(hex(o_orderkey)), 64, '0'))"
_BODIES = (
    """concat('{"exists": true, "transaction_count": 1, "matching_edge_ids": ["E1"], "matching_tx_hashes": ["', h, '"]}')""",
    """'{"exists": false, "transaction_count": 0, "matching_edge_ids": [], "matching_tx_hashes": []}'""",
    """'So: {"exists": true} as shown'""",
    """concat('```json\\n{"exists": true, "transaction_count": "1", "matching_edge_ids": [7], "matching_tx_hashes": ["', h, '"], "note": 1}\\n```')""",
    """concat('{"exists": true, "transaction_count": 1, "matching_edge_ids": ["a", "A"], "matching_tx_hashes": ["', h, '", "', h, '"]}')""",
    """'{"exists": true, "transaction_count": 1, "matching_edge_ids": ["a"], "matching_tx_hashes": ["0x12"]}'""",
    """concat('{"exists": false, "transaction_count": 1, "matching_edge_ids": ["a"], "matching_tx_hashes": ["', h, '"]}')""",
    "'no object here'",
)
#: What each form of answer breaks.
_ERRORS = (
    "[]",
    "[]",
    "['count_not_whole', 'edge_ids_not_list', 'exists_against_count', 'exists_without_edges', 'missing_fields', 'tx_hashes_not_list']",
    "['count_against_hashes', 'count_not_whole', 'exists_against_count', 'unexpected_fields']",
    "['edge_ids_repeat', 'tx_hashes_repeat']",
    "['invalid_hashes']",
    "['absent_with_ids', 'exists_against_count']",
    "['no_object']",
)


def _cases(bodies) -> str:
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(bodies)) + " END"


def stored_answers(t: Tables) -> DataFrame:
    """Answers in eight forms, right and wrong ones."""
    return t.orders.selectExpr("o_orderkey", f"{_HASH} as h").selectExpr("o_orderkey as task_id", f"{_cases(_BODIES)} as answer")


@query(
    "check_existence_answer",
    f"""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 8 IN (0, 2, 3, 4, 5) THEN true WHEN o_orderkey % 8 IN (1, 6) THEN false END AS found, CASE WHEN o_orderkey % 8 IN (0, 4, 5, 6) THEN 1 ELSE 0 END AS n, {_cases(_ERRORS)} AS errors FROM orders""",
)
def check_existence_answer(t: Tables) -> DataFrame:
    return A.existence_answer(stored_answers(t)).select("task_id", "found", "n", "errors")


def _protocol(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Answers, and what their tool calls were worth: every line of an order is a call."""
    keys = t.orders.selectExpr("o_orderkey as task_id", f"{_HASH} as h", "concat('0x', lpad(lower(hex(o_custkey)), 40, '0')) as src")
    tasks = keys.select("task_id", "src", F.lit("out").alias("direction"), F.lit(0).alias("block_min"), F.lit(1000).alias("block_max"), F.array(F.lit(1)).alias("edge_types"), F.lit(True).alias("with_hashes"), F.array(F.lit("neighbors")).alias("required"), F.array(F.lit("neighbors"), F.lit("node")).alias("allowed"))
    calls = t.lineitem.join(keys, F.col("l_orderkey") == F.col("task_id")).selectExpr(
        "task_id",
        "if(l_returnflag = 'R', 'graph', 'neighbors') as tool",
        "if(l_linenumber = 6, 'error', 'ok') as status",
        "if(l_linenumber = 5, '0x0', upper(src)) as address",
        "if(l_linenumber = 4, 'in', 'out') as direction",
        "0 as block_min",
        "if(l_linenumber = 3, 999, 1000) as block_max",
        "l_linenumber % 3 as edge_type",
        "l_linestatus = 'F' as with_raw",
        "true as complete",
        "if(task_id % 8 = 0, array('E1'), array()) as edge_ids",
        "if(task_id % 8 = 0, array(h), array()) as tx_hashes",
    )
    answers = A.existence_answer(stored_answers(t))
    return answers, A.existence_protocol(tasks, calls, answers)


_CALLS = """c AS (SELECT o_orderkey, l_linenumber AS i, l_returnflag <> 'R' AS look, l_linestatus = 'F' AS raw, i <> 6 AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
 g AS (SELECT o_orderkey, count(i) AS n_calls, count(*) FILTER (look) AS n_look, count(*) FILTER (look AND raw AND i IN (1, 7)) AS n_valid, count(*) FILTER (look AND ok) AS n_done, count(*) FILTER (NOT look) AS n_graph, count(*) FILTER (look AND i = 5) AS a, count(*) FILTER (look AND i = 4) AS d, count(*) FILTER (look AND i = 3) AS w, count(*) FILTER (look AND i % 3 <> 1) AS e, count(*) FILTER (look AND NOT raw) AS r, count(*) FILTER (look AND i = 6) AS s FROM c GROUP BY o_orderkey),
 p AS (SELECT *, o_orderkey % 8 IN (0, 1) AS valid_answer, o_orderkey % 8 = 1 OR (o_orderkey % 8 = 0 AND n_valid > 0) AS grounded FROM g),
 pe AS (SELECT *, list_sort(list_filter([CASE WHEN n_done = 0 THEN 'required_missing' END, CASE WHEN n_graph > 0 THEN 'disallowed' END, CASE WHEN n_valid = 0 THEN 'types_not_queried' END, CASE WHEN NOT valid_answer THEN 'invalid_answer' END, CASE WHEN valid_answer AND NOT grounded THEN 'not_grounded' END,
 CASE WHEN a > 0 THEN 'call_address' END, CASE WHEN d > 0 THEN 'call_direction' END, CASE WHEN w > 0 THEN 'call_window' END, CASE WHEN e > 0 THEN 'call_edge_type' END, CASE WHEN r > 0 THEN 'call_with_raw' END, CASE WHEN s > 0 THEN 'call_incomplete' END], lambda x: x IS NOT NULL)) AS errors FROM p)"""


@query("protocol_existence", f"WITH {_CALLS} SELECT o_orderkey AS task_id, errors, n_calls, n_valid, grounded, CASE WHEN n_done > 0 THEN 1.0 ELSE 0.0 END AS required_share, CASE WHEN n_look > 0 THEN n_valid / n_look ELSE 0.0 END AS parameter_accuracy FROM pe")
def protocol_existence(t: Tables) -> DataFrame:
    return _protocol(t)[1]


@query(
    "score_existence",
    f"""WITH {_CALLS}, x AS (SELECT o_orderkey AS task_id, o_orderkey % 8 AS k, o_orderkey % 8 IN (0, 4, 6) AS gold, errors FROM pe), y AS (SELECT *, k IN (0, 1) AS good, CASE WHEN k = 0 OR NOT gold THEN 1.0 ELSE 0.0 END AS pr FROM x)
 SELECT task_id, CAST(good AS DOUBLE) AS existence_accuracy, CAST(good AS DOUBLE) AS count_accuracy, pr AS edge_precision, pr AS edge_recall, pr AS hash_precision, pr AS hash_recall, CASE WHEN gold THEN CAST(good AS DOUBLE) END AS positive_accuracy, CASE WHEN NOT gold THEN CAST(good AS DOUBLE) END AS negative_accuracy,
 CASE WHEN task_id % 3 = 0 AND NOT gold THEN CAST(good AS DOUBLE) END AS reversal_accuracy, good AS task_pass, len(errors) = 0 AS protocol_pass, good AND len(errors) = 0 AS passed FROM y""",
)
def score_existence(t: Tables) -> DataFrame:
    answers, protocol = _protocol(t)
    found = F.col("o_orderkey") % 8
    there = found.isin(0, 4, 6)
    none = F.array().cast("array<string>")
    gold = t.orders.select(F.col("o_orderkey").alias("task_id"), there.alias("found"), F.when(there, 1).otherwise(0).alias("n"), F.when(there, F.array(F.lit("e1"))).otherwise(none).alias("edge_ids"), F.when(there, F.array(F.expr(_HASH))).otherwise(none).alias("tx_hashes"), F.when((F.col("o_orderkey") % 3 == 0) & ~there, "reversed_direction").alias("negative_type"))
    return A.existence_scores(answers, gold, protocol)


@query(
    "attach_protocol",
    f"""WITH {_CALLS} SELECT p.o_orderkey AS task_id, profile, task_pass, CASE WHEN profile = 'tool_grounded' THEN len(errors) = 0 END AS protocol_pass, CASE WHEN profile = 'tool_grounded' THEN task_pass AND len(errors) = 0 ELSE task_pass END AS passed, CASE WHEN profile = 'tool_grounded' THEN CASE WHEN grounded THEN 5.0 ELSE 0.0 END END AS groundedness
 FROM pe p JOIN (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'context' ELSE 'tool_grounded' END AS profile, o_orderstatus = 'F' AS task_pass FROM orders) o USING (o_orderkey)""",
)
def attach_protocol(t: Tables) -> DataFrame:
    judged = t.orders.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderpriority") == "5-LOW", "context").otherwise("tool_grounded").alias("profile"), (F.col("o_orderstatus") == "F").alias("task_pass"))
    return A.with_protocol(judged, _protocol(t)[1])


@query(
    "repair_guard",
    """SELECT o_orderkey AS task_id, o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND o_orderkey % 3 = 1 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS accepted FROM orders""",
)
def repair_guard(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    selected, other = F.lit("selected_follow_edges of state 1"), F.lit("probability")
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "transaction_existence").otherwise("path_completion").alias("task_type")
    decision = lambda status: F.array(F.struct(F.lit("s1").alias("state_id"), status.alias("action")))
    errors = F.when(key % 3 == 0, F.array().cast("array<string>")).when(key % 3 == 1, F.array(selected)).otherwise(F.array(selected, other))
    original = t.orders.select(key.alias("task_id"), kind, decision(F.col("o_orderstatus")).alias("decisions"), errors.alias("errors"))
    # Some answers have no repair, some change a decision, some are still wrong.
    repaired = t.orders.where(key % 7 != 0).select(key.alias("task_id"), decision(F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus"))).alias("decisions"), F.when(key % 5 == 0, F.array(other)).otherwise(F.array().cast("array<string>")).alias("errors"))
    return A.accepted_repairs(original, repaired)


_FOLLOWED = "stage IN ('theft', 'cash_out')"


@query(
    "check_sequential_answer",
    f"""WITH RECURSIVE st AS (SELECT DISTINCT case_id, src FROM ev_edges), s0 AS (SELECT case_id, min(src) AS node FROM ev_edges WHERE stage = 'theft' GROUP BY case_id),
 r(case_id, node) AS (SELECT case_id, node FROM s0 UNION SELECT e.case_id, e.dst FROM r JOIN ev_edges e ON e.case_id = r.case_id AND e.src = r.node AND e.{_FOLLOWED} JOIN st ON st.case_id = e.case_id AND st.src = e.dst),
 n AS (SELECT case_id, count(*) AS n_steps, count(*) FILTER ((case_id, src) NOT IN (SELECT (case_id, node) FROM r)) AS n_unreached FROM st GROUP BY case_id),
 m AS (SELECT case_id, count(*) FILTER (stage = 'layering' AND pattern = 'split') AS lost FROM ev_edges GROUP BY case_id)
 SELECT case_id AS task_id, list_sort(list_filter([CASE WHEN lost > 0 THEN 'edge_missing' END, CASE WHEN n_unreached > 0 THEN 'not_reached' END, CASE WHEN n_steps > 40 THEN 'too_many_steps' END, 'seed_twice', 'too_many_seeds'], lambda x: x IS NOT NULL)) AS errors, n_steps, n_unreached FROM n JOIN m USING (case_id)""",
)
def check_sequential_answer(t: Tables) -> DataFrame:
    # Eight tables derive from the reported edges: these are written once.
    e = kept(t.ev_edges.select(F.col("case_id").alias("task_id"), F.col("src").alias("state_id"), F.col("reported_id").alias("edge_id"), "src", "dst", "stage", "pattern"))
    states = e.select("task_id", "state_id", F.col("src").alias("node")).distinct()
    steps = e.groupBy("task_id", "state_id").agg(F.upper(F.first("src")).alias("node"), F.collect_list(F.when(F.expr(_FOLLOWED), F.col("edge_id"))).alias("selected"))
    p = F.when(F.expr(_FOLLOWED), 1.0).otherwise(0.0)
    decisions = e.where("not (stage = 'layering' and pattern = 'split')").select("task_id", "state_id", "edge_id", F.when(p == 1, "follow").otherwise("ignore").alias("action"), p.alias("p_follow"), F.lit(0.0).alias("p_inspect"), F.lit(0.0).alias("p_stop"), (1 - p).alias("p_ignore"))
    seeds = F.array(F.lit("a"), F.lit("a"))
    starts = e.groupBy("task_id").agg(F.min(F.when(F.col("stage") == "theft", F.col("src"))).alias("start_node"))
    tasks = starts.select("task_id", "start_node", F.lit(40).alias("max_steps"), F.lit(10**9).alias("max_edges"), seeds.alias("seeds"), F.lit(1).alias("top_k"), seeds.alias("selected_seeds"))
    return A.sequential_errors(tasks, states, e.select("task_id", "state_id", "edge_id", "dst"), steps, decisions, kept)


_BIN = "len(list_filter([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e <= p_follow))"


@query(
    "score_sequential",
    f"""WITH {_PRED}, m AS (SELECT case_id AS task_id, mode, src, edge_id, gold, action, p_follow, p_inspect, p_stop, p_ignore FROM a, (VALUES ('teacher_forced'), ('free_rollout')) v(mode) WHERE mode = 'teacher_forced' OR p_follow >= 0.2),
 s AS (SELECT task_id, mode, count(*) FILTER (action = 'follow' AND p_follow >= 0.5) AS nf, count(*) FILTER (gold = 'follow') AS ng, count(*) FILTER (action = 'follow' AND p_follow >= 0.5 AND gold = 'follow') AS nb, avg(CAST(action = gold AS INTEGER)) AS accuracy,
 avg((p_follow - CAST(gold = 'follow' AS INTEGER)) ** 2 + (p_inspect - CAST(gold = 'inspect' AS INTEGER)) ** 2 + (p_stop - CAST(gold = 'stop' AS INTEGER)) ** 2 + (p_ignore - CAST(gold = 'ignore' AS INTEGER)) ** 2) AS brier, count(DISTINCT src) AS n_steps, count(*) AS n_edges FROM m GROUP BY ALL),
 c AS (SELECT task_id, mode, unnest(['follow', 'inspect', 'stop', 'ignore']) AS c, action, gold FROM m), k AS (SELECT task_id, mode, c, count(*) FILTER (action = c AND gold = c) AS tp, count(*) FILTER ((action = c) <> (gold = c)) AS err FROM c GROUP BY ALL), f AS (SELECT task_id, mode, avg(2 * tp / (2 * tp + err)) AS macro_f1 FROM k WHERE tp + err > 0 GROUP BY ALL),
 b AS (SELECT task_id, mode, {_BIN} AS bin, count(*) AS n, avg(p_follow) AS conf, avg(CAST(gold = 'follow' AS INTEGER)) AS acc FROM m GROUP BY ALL), x AS (SELECT task_id, mode, sum(n * abs(conf - acc)) / sum(n) AS ece FROM b GROUP BY ALL),
 z AS (SELECT *, CASE WHEN nf = 0 THEN 0.0 ELSE nb / nf END AS prec, CASE WHEN ng = 0 THEN 0.0 ELSE nb / ng END AS recall FROM s)
 SELECT task_id, mode, prec, recall, CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0.0 END AS f1, accuracy, macro_f1, brier, ece, CASE WHEN ng > 0 THEN nb / ng ELSE CAST(nf = 0 AS DOUBLE) END AS coverage, nb > 0 AS complete, n_steps, n_edges FROM z JOIN f USING (task_id, mode) JOIN x USING (task_id, mode)""",
)
def score_sequential(t: Tables) -> DataFrame:
    modes = F.explode(F.when(F.col("p_follow") >= 0.2, F.array(F.lit("teacher_forced"), F.lit("free_rollout"))).otherwise(F.array(F.lit("teacher_forced"))))
    rows = predictions(t).withColumn("mode", modes).withColumnsRenamed({"case_id": "task_id", "src": "state_id"})
    paths = rows.where("action = 'follow' and p_follow >= 0.5").select("task_id", "mode", F.array("edge_id").alias("path"))
    gold = predictions(t).where("gold = 'follow'").select(F.col("case_id").alias("task_id"), F.array("edge_id").alias("path"))
    return A.sequential_scores(rows, paths, gold)
