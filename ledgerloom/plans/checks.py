"""Validation queries: rows are violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audits
from ..operators.relational import kept
from ..registry import query
from ..views import Tables
from .scalars import ORACLE_KEYS, public_rows


def violations(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(rule, id) of several checks."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id")) for rule, df, key in parts))


@query("check_hops", """SELECT rule, id FROM (SELECT edge_id AS id, CASE WHEN h IS NULL THEN 'missing' WHEN h < 1 THEN 'low' WHEN h > 2 THEN 'high' END AS rule FROM (SELECT edge_id, CASE WHEN asset = 'A' THEN NULL ELSE edge_type + CASE WHEN status = 'P' THEN 2 ELSE 0 END END AS h FROM dense) x) y WHERE rule IS NOT NULL""")
def check_hops(t: Tables) -> DataFrame:
    hop = F.when(F.col("asset") != "A", F.col("edge_type") + F.when(F.col("status") == "P", 2).otherwise(0))
    rows = t.dense.select("edge_id", hop.alias("hop"))
    return violations([("missing", rows.where("hop is null"), "edge_id"), ("low", rows.where("hop < 1"), "edge_id"), ("high", rows.where("hop > 2"), "edge_id")])


@query("check_labels_candidates", """SELECT 'label_without_edge' AS rule, reported_id AS id FROM ev_edges WHERE substr(reported_id, 2) NOT IN (SELECT substr(edge_id, 5) FROM dense WHERE edge_type = 0) UNION ALL SELECT 'small_set', case_id || '|' || src || '|' || asset FROM dense GROUP BY case_id, src, asset HAVING count(DISTINCT dst) < 20""")
def check_labels_candidates(t: Tables) -> DataFrame:
    edges = t.dense.where("edge_type = 0").select(F.expr("concat('R', substr(edge_id, 5))").alias("reported_id"))
    lost = t.ev_edges.join(edges, "reported_id", "left_anti")
    small = t.dense.groupBy("case_id", "src", "asset").agg(F.count_distinct("dst").alias("n")).where("n < 20").withColumn("key", F.concat_ws("|", "case_id", "src", "asset"))
    return violations([("label_without_edge", lost, "reported_id"), ("small_set", small, "key")])


#: Types that are no longer asked.
DEPRECATED = ("single_hop_next_hop_prediction", "direct_link_verification")


def task_violations(tasks: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, id) of tasks (task_id, task_type, answer, context as a map) and of their candidates (task_id, candidate_id):
    no answer, a deprecated type, an oracle key in the context, a candidate that is neither an edge nor summed up (``known``: candidate_id)."""
    leak = F.size(F.array_intersect(F.map_keys("context"), F.array(*map(F.lit, ORACLE_KEYS)))) > 0
    lost = candidates.join(known.select("candidate_id").distinct(), "candidate_id", "left_anti")
    return violations([("no_answer", tasks.where("answer is null or answer = ''"), "task_id"), ("deprecated_type", tasks.where(F.col("task_type").isin(*DEPRECATED)), "task_id"), ("leak", tasks.where(leak), "task_id"), ("candidate_unknown", lost, "candidate_id")])


@query("check_tasks", """SELECT 'no_answer' AS rule, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'deprecated_type', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'leak', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'candidate_unknown', 'pair:' || edge_id FROM dense WHERE edge_type = 1 AND asset = 'R'""")
def check_tasks(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "5-LOW", DEPRECATED[0]).otherwise("path_completion")
    tasks = t.orders.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") != "P", "a").alias("answer"), kind.alias("task_type"), F.create_map(F.when(F.col("o_orderkey") % 10 == 0, "gold_paths").otherwise("edges"), F.lit(1)).alias("context"))
    pair = F.concat(F.lit("pair:"), "edge_id")
    candidates = t.dense.select(F.col("tx_hash").alias("task_id"), F.when(F.col("edge_type") == 0, F.col("edge_id")).otherwise(pair).alias("candidate_id"))
    summed = t.dense.where("asset != 'R'").select(pair.alias("candidate_id"))
    return task_violations(tasks, candidates, t.dense.select(F.col("edge_id").alias("candidate_id")).unionByName(summed))


@query("check_existence_tasks", """SELECT 'not_in_chain' AS rule, CAST(l_orderkey AS VARCHAR) AS id FROM lineitem WHERE l_quantity > 49 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'window', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09""")
def check_existence_tasks(t: Tables) -> DataFrame:
    tasks = t.lineitem.where("l_quantity > 49").select("l_orderkey", "l_discount")
    real = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return violations([("not_in_chain", tasks.join(real, "l_orderkey", "left_anti"), "l_orderkey"), ("window", tasks.where("l_discount > 0.09"), "l_orderkey")])


@query("check_profiles", """SELECT 'tool_without_budget' AS rule, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' UNION ALL SELECT 'context_with_budget', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'P'""")
def check_profiles(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("tool"), F.when(F.col("o_orderstatus") == "F", 5).when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") != "1-URGENT"), 2).otherwise(0).alias("budget"))
    rows = rows.withColumn("budget", F.when(~F.col("tool") & (F.col("budget") == 5), 0).otherwise(F.col("budget")))
    return violations([("tool_without_budget", rows.where("tool and budget = 0"), "o_orderkey"), ("context_with_budget", rows.where("not tool and budget > 0"), "o_orderkey")])


@query("check_gold", """SELECT CASE WHEN edge_type = 0 THEN 'candidate_without_gold' ELSE 'gold_without_candidate' END AS rule, edge_id AS id FROM dense WHERE (edge_type = 0) <> (asset = 'A')""")
def check_gold(t: Tables) -> DataFrame:
    asked = t.dense.where("edge_type = 0").select("edge_id")
    gold = t.dense.where("asset = 'A'").select("edge_id", F.lit("follow").alias("action"))
    both = asked.withColumn("asked", F.lit(True)).join(gold, "edge_id", "full_outer")
    return violations([("candidate_without_gold", both.where("action is null"), "edge_id"), ("gold_without_candidate", both.where("asked is null"), "edge_id")])


def _leaks(value: Column, kind: T.DataType) -> Column:
    """Whether a value holds an oracle key among its struct fields and map keys, at any depth."""
    if isinstance(kind, T.StructType):
        each = [value[f.name].isNotNull() if f.name in ORACLE_KEYS else _leaks(value[f.name], f.dataType) for f in kind.fields]
        return reduce(Column.__or__, each, F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: _leaks(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        keys = F.exists(F.map_keys(value), lambda k: k.cast("string").isin(*ORACLE_KEYS) | _leaks(k, kind.keyType))
        return F.coalesce(keys | F.exists(F.map_values(value), lambda v: _leaks(v, kind.valueType)), F.lit(False))
    return F.lit(False)


def count_leaks(rows: DataFrame) -> DataFrame:
    """n_leaks: rows that hold an oracle key, as a column or within one; n_rows."""
    each = [F.lit(True) if f.name in ORACLE_KEYS else _leaks(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields]
    return rows.agg(F.count_if(reduce(Column.__or__, each, F.lit(False))).cast("int").alias("n_leaks"), F.count("*").alias("n_rows"))


@query("leak_check", "SELECT 0 AS n_leaks, count(*) AS n_rows FROM dense")
def leak_check(t: Tables) -> DataFrame:
    return count_leaks(public_rows(t))


@query(
    "existence_task_audit",
    """WITH g AS (SELECT case_id || '|' || src || '|' || dst || '|' || edge_type AS id, count(*) AS n, count(*) FILTER (asset <> 'R') AS known, count(*) FILTER (status = 'P') AS pending, count(DISTINCT tx_hash) AS h, count(DISTINCT tx_hash) FILTER (asset <> 'R') AS hk FROM dense GROUP BY case_id, src, dst, edge_type)
 SELECT unnest(list_filter([CASE WHEN pending = n THEN 'chain_or_direction' END, CASE WHEN pending > 0 THEN 'shows_edges' END, CASE WHEN known = 0 AND pending = 0 THEN 'not_verified_absent' END, CASE WHEN known = 0 THEN 'oracle_found' END, CASE WHEN h <> hk THEN 'oracle_n_tx' END, CASE WHEN n <> known THEN 'oracle_n_edges' END, CASE WHEN n <> known THEN 'oracle_edge_ids' END, CASE WHEN h <> hk THEN 'oracle_tx_hashes' END], lambda r: r IS NOT NULL)) AS rule, id FROM g""",
)
def existence_task_audit(t: Tables) -> DataFrame:
    """One task a pair of addresses and type; what is stored of it leaves out one asset, and pending transfers show."""
    known, ids = F.col("asset") != "R", lambda c: F.sort_array(F.collect_set(F.when(F.col("asset") != "R", F.col(c))))
    # Read four times; the window of a case is a row of a small table.
    edges = kept(t.dense.select("case_id", "edge_id", "src", "dst", "tx_hash", "block_number", "edge_type", "asset", "status"))
    window = kept(edges.groupBy("case_id").agg(F.min("block_number").alias("block_min"), F.max("block_number").alias("block_max")))
    tasks = edges.groupBy("case_id", "src", "dst", "edge_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "P").alias("n_shown"), ids("edge_id").alias("edge_ids"), ids("tx_hash").alias("tx_hashes"), F.count_if(known).alias("n_edges"))
    tasks = tasks.join(window, "case_id").select(
        F.concat_ws("|", "case_id", "src", "dst", F.col("edge_type").cast("string")).alias("task_id"), "case_id", "src", "dst", F.lit("ethereum").alias("chain"),
        F.when(F.col("n_shown") == F.col("n"), "in").otherwise("out").alias("direction"), "block_min", "block_max", F.array("edge_type").alias("edge_types"), "n_shown", F.lit("tool_grounded").alias("profile"),
        F.lit("required").alias("tool_requirement"), F.array(F.lit("neighbors")).alias("required_tools"), F.lit("query_only").alias("public_profile"),
        (F.col("n_edges") > 0).alias("found"), F.size("tx_hashes").cast("long").alias("n_tx"), "n_edges", "edge_ids", "tx_hashes", (F.col("n_shown") > 0).alias("verified_absent"),
    )
    return audits.existence_violations(kept(tasks), edges)


@query(
    "profile_audit",
    """WITH g AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, count(DISTINCT l_linenumber) AS n, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS kept FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
 SELECT unnest(list_filter([CASE WHEN s NOT IN ('F', 'O') THEN 'unknown_profile' END, CASE WHEN s = 'F' AND p = '1-URGENT' THEN 'grounded_tools' END, CASE WHEN s = 'F' AND (kept = 0 OR kept <> n) THEN 'groups_not_candidates' END, CASE WHEN s = 'F' AND kept <> n THEN 'budget' END, CASE WHEN s = 'O' AND p = '2-HIGH' THEN 'context_requirement' END, CASE WHEN s = 'O' AND p = '3-MEDIUM' THEN 'context_public_profile' END], lambda r: r IS NOT NULL)) AS rule, CAST(o_orderkey AS VARCHAR) AS id FROM g""",
)
def profile_audit(t: Tables) -> DataFrame:
    """One task an order: its lines are candidates, those that did not come back are grouped."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("candidates"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("string"))).alias("groups"))
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").join(lines, "o_orderkey", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("candidates", "groups")})
    filled = F.col("o_orderstatus") == "F"
    is_ = lambda p: F.col("o_orderpriority") == p
    edge, none = F.array(F.lit("edge")), F.array().cast("array<string>")
    contract = F.struct(F.lit("edge").alias("tool"), F.lit(True).alias("with_raw"), F.lit(1).alias("per_candidate"), F.size("groups").alias("candidate_count"), F.size("candidates").alias("max_calls"))
    tasks = rows.select(
        F.col("o_orderkey").alias("task_id"),
        F.when(filled, "tool_grounded").when(F.col("o_orderstatus") == "O", "context_only").otherwise("other").alias("profile"),
        F.when(filled, edge).otherwise(none).alias("required_tools"),
        F.when(filled & is_("1-URGENT"), F.array(F.lit("edge"), F.lit("graph"))).when(filled, edge).otherwise(none).alias("allowed_tools"),
        F.when(filled | is_("2-HIGH"), "required").otherwise("disabled").alias("tool_requirement"),
        F.when(filled, "candidate_tool_query").when(is_("3-MEDIUM"), "query_only").otherwise("graph_context").alias("public_profile"),
        "candidates", "groups", contract.alias("contract"),
    )
    return audits.profile_violations(tasks)


@query(
    "tracing_protocol_audit",
    """WITH c AS (SELECT l_orderkey AS t, (l_linenumber, l_partkey, l_suppkey) AS turn, l_returnflag = 'R' AS graph, CASE WHEN l_linenumber = 6 THEN 99 ELSE l_linenumber % 4 + 1 END AS k, l_linenumber <> 5 AS raw, l_linestatus = 'F' AS ok FROM lineitem),
 m AS (SELECT DISTINCT l_orderkey AS t, l_partkey % 3 AS g, l_linenumber AS k FROM lineitem),
 r AS (SELECT c.*, NOT graph AND EXISTS (SELECT 1 FROM m WHERE m.t = c.t AND m.k = c.k) AS member, row_number() OVER (PARTITION BY c.t, graph, k ORDER BY turn) AS nth FROM c),
 v AS (SELECT *, NOT graph AND raw AND member AND ok AND nth = 1 AS valid FROM r),
 s AS (SELECT t, count(*) AS n_calls, count(*) FILTER (NOT graph) AS n_lookups, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (NOT graph AND ok) AS done, count(*) FILTER (graph) AS others, count(*) FILTER (NOT graph AND NOT raw) AS a, count(*) FILTER (NOT graph AND NOT member) AS b, count(*) FILTER (NOT graph AND NOT ok) AS d, count(*) FILTER (NOT graph AND nth > 1) AS e FROM v GROUP BY t),
 g AS (SELECT m.t, count(DISTINCT m.g) AS candidates, count(DISTINCT CASE WHEN v.valid THEN m.g END) AS covered FROM m LEFT JOIN v ON v.t = m.t AND v.k = m.k AND v.valid GROUP BY m.t)
 SELECT o_orderkey AS task_id, list_sort(list_filter([CASE WHEN coalesce(done, 0) = 0 THEN 'required_missing' END, CASE WHEN others > 0 THEN 'disallowed' END, CASE WHEN covered < candidates THEN 'uncovered' END, CASE WHEN n_calls > 5 THEN 'over_budget' END, CASE WHEN o_orderstatus = 'P' THEN 'invalid_answer' END, CASE WHEN a > 0 THEN 'call_without_raw' END, CASE WHEN b > 0 THEN 'call_outside' END, CASE WHEN d > 0 THEN 'call_failed' END, CASE WHEN e > 0 THEN 'call_repeated' END], lambda x: x IS NOT NULL)) AS errors,
 coalesce(n_calls, 0) AS n_calls, coalesce(n_valid, 0) AS n_valid, coalesce(covered, 0) AS covered, coalesce(covered / candidates, 0) AS coverage, CASE WHEN n_lookups > 0 THEN n_valid / n_lookups ELSE 0 END AS parameter_accuracy, CASE WHEN n_calls > 0 THEN (n_lookups - n_valid) / n_calls ELSE 0 END AS unnecessary_share, CASE WHEN n_calls > 0 THEN n_failed / n_calls ELSE 0 END AS error_share
 FROM orders LEFT JOIN s ON s.t = o_orderkey LEFT JOIN g ON g.t = o_orderkey""",
)
def tracing_protocol_audit(t: Tables) -> DataFrame:
    """One task an order: its lines are calls in turn, those that came back of another tool."""
    edge = F.array(F.lit("edge"))
    tasks = t.orders.select(F.col("o_orderkey").alias("task_id"), edge.alias("required"), edge.alias("allowed"), F.lit(5).alias("max_calls"))
    key = F.col("l_orderkey").alias("task_id")
    groups = t.lineitem.select(key, (F.col("l_partkey") % 3).alias("candidate_id"), F.concat(F.lit("eth:00"), F.col("l_linenumber").cast("string")).alias("edge_id"))
    asked = F.when(F.col("l_linenumber") == 6, 99).otherwise(F.col("l_linenumber") % 4 + 1)
    calls = t.lineitem.select(key, F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("turn"), F.when(F.col("l_returnflag") == "R", "graph").otherwise("edge").alias("tool"), asked.cast("string").alias("edge_id"), (F.col("l_linenumber") != 5).cast("string").alias("with_raw"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("error").alias("status"))
    answers = t.orders.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("task_id"))
    done = audits.tracing_protocol(tasks, groups, calls, answers)
    return done.select("task_id", "errors", "n_calls", "n_valid", "covered", "coverage", "parameter_accuracy", "unnecessary_share", "error_share")
