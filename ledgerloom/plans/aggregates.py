"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evidence as E
from ..operators import policies
from ..operators import summaries as A
from ..registry import query
from ..views import Tables

_ACT = "CASE WHEN asset = 'A' AND edge_type = 0 THEN 'follow' WHEN status = 'P' AND edge_type = 1 AND asset = 'N' THEN NULL ELSE 'ignore' END"


def acted(t: Tables) -> DataFrame:
    action = F.when((F.col("asset") == "A") & (F.col("edge_type") == 0), "follow").when((F.col("status") == "P") & (F.col("edge_type") == 1) & (F.col("asset") == "N"), F.lit(None)).otherwise("ignore")
    return t.dense.withColumns({"action": action, "hop": F.col("edge_type") + 1})


@query("pair_candidates", f"""SELECT case_id, src, dst, 'pair:' || substr(sha256('["' || case_id || '", "' || src || '", "' || dst || '"]'), 1, 16) AS candidate_id, count(*) AS edge_count, count(DISTINCT tx_hash) AS tx_count, list(edge_id ORDER BY sha256(edge_id))[1:12] AS edge_ids, list(DISTINCT tx_hash ORDER BY tx_hash)[1:12] AS tx_hashes, list(DISTINCT asset ORDER BY asset) AS assets, min(action) AS action, min(hop) AS hop FROM (SELECT *, {_ACT} AS action, edge_type + 1 AS hop FROM dense) x GROUP BY case_id, src, dst HAVING count(DISTINCT action) = 1""")
def pair_candidates(t: Tables) -> DataFrame:
    return A.pair_candidates(acted(t))


@query("candidate_amounts", """SELECT case_id, src, dst, CAST(CASE WHEN n_tokens = 1 OR (n_tokens = 0 AND n_assets <= 1) THEN total ELSE 0 END AS DOUBLE) AS amount, n_tokens = 1 OR (n_tokens = 0 AND n_assets <= 1) AS comparable, min_ts, max_ts, min_block, max_block FROM (SELECT case_id, src, dst, sum(amount) AS total, count(DISTINCT token_address) AS n_tokens, count(DISTINCT asset) AS n_assets, min(ts) AS min_ts, max(ts) AS max_ts, min(CASE WHEN block_number > 0 THEN block_number END) AS min_block, max(CASE WHEN block_number > 0 THEN block_number END) AS max_block FROM dense GROUP BY ALL) x""")
def candidate_amounts(t: Tables) -> DataFrame:
    return A.candidate_amounts(t.dense).withColumn("amount", F.col("amount").cast("double"))


@query("tx_evidence", """SELECT case_id, tx_hash, min(edge_id) AS edge_id, arg_min(src, edge_id) AS src, arg_min(dst, edge_id) AS dst, CAST(arg_min(amount, edge_id) AS DOUBLE) AS amount, count(*) AS n_edges, min(ts) AS ts, len(list_distinct(list_concat(list(src), list(dst)))) AS n_addresses FROM dense GROUP BY case_id, tx_hash""")
def tx_evidence(t: Tables) -> DataFrame:
    return A.tx_evidence(t.dense).withColumn("amount", F.col("amount").cast("double"))


@query("block_window", """SELECT case_id, greatest(0, min(block_number) - 120000) AS start_block, max(block_number) + 120000 AS end_block FROM dense WHERE priority = '1-URGENT' GROUP BY case_id""")
def block_window(t: Tables) -> DataFrame:
    return A.block_window(t.dense.where("priority = '1-URGENT'"), 120_000)


def _counts_sql(table: str, columns: list[str], where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {where} GROUP BY {c}" for c in columns)


@query("bundle_manifest", _counts_sql("dense", ["asset", "edge_type", "status", "case_id"]))
def bundle_manifest(t: Tables) -> DataFrame:
    return A.counts_by(t.dense.select("asset", "edge_type", "status", "case_id"), ["asset", "edge_type", "status", "case_id"])


@query("qa_manifest", _counts_sql("ev_edges", ["stage", "pattern", "confidence", "verification_status"]))
def qa_manifest(t: Tables) -> DataFrame:
    return A.counts_by(t.ev_edges.select("stage", "pattern", "confidence", "verification_status"), ["stage", "pattern", "confidence", "verification_status"])


@query("existence_oracle", """SELECT src, dst, edge_type, count(DISTINCT edge_id) > 0 AS found, count(DISTINCT tx_hash) AS n_tx, count(DISTINCT edge_id) AS n_edges, list(DISTINCT tx_hash ORDER BY tx_hash) AS hashes FROM dense WHERE block_number BETWEEN 7200 * 900 AND 7200 * 2500 GROUP BY ALL""")
def existence_oracle(t: Tables) -> DataFrame:
    rows = t.dense.where("block_number between 7200 * 900 and 7200 * 2500")
    return rows.groupBy("src", "dst", "edge_type").agg((F.count("*") > 0).alias("found"), F.count_distinct("tx_hash").alias("n_tx"), F.count_distinct("edge_id").alias("n_edges"), F.array_sort(F.collect_set("tx_hash")).alias("hashes"))


@query("whole_graph_node_features", """WITH n AS (SELECT case_id, src AS node, dst AS other, 1 AS o, CASE WHEN token_address IS NULL THEN amount END AS native, ts, CAST(src = dst AS INTEGER) AS lp FROM dense UNION ALL SELECT case_id, dst, src, 0, CASE WHEN token_address IS NULL THEN amount END, ts, 0 FROM dense)
 SELECT case_id, node, ln(1 + sum(o)) AS out_degree, ln(1 + count(*) - sum(o)) AS in_degree, ln(1 + count(DISTINCT CASE WHEN o = 1 THEN other END)) AS out_counterparties, ln(1 + count(DISTINCT CASE WHEN o = 0 THEN other END)) AS in_counterparties, ln(1 + coalesce(sum(CASE WHEN o = 1 THEN native END), 0)::DOUBLE) AS out_native, ln(1 + coalesce(sum(CASE WHEN o = 0 THEN native END), 0)::DOUBLE) AS in_native, ln(1 + coalesce(max(CASE WHEN o = 1 THEN native END), 0)::DOUBLE) AS out_max, count(native) / count(*) AS native_share, ln(1 + max(ts) - min(ts)) AS span, ln(1 + sum(lp)) AS self_loops FROM n GROUP BY case_id, node""")
def whole_graph_node_features(t: Tables) -> DataFrame:
    return A.whole_graph_nodes(t.dense)


@query("seed_node_features", """WITH o AS (SELECT case_id, src AS node, sum(amount) AS a, count(*) AS n, max(amount) AS m FROM dense GROUP BY ALL), i AS (SELECT case_id, dst AS node, sum(amount) AS a, count(*) AS n FROM dense GROUP BY ALL)
 SELECT case_id, node, CAST(coalesce(o.a, 0) AS DOUBLE) AS out_amount, coalesce(o.n, 0) AS n_out, CAST(coalesce(o.m, 0) AS DOUBLE) AS max_out, CAST(coalesce(i.a, 0) AS DOUBLE) AS in_amount, coalesce(i.n, 0) AS n_in, CAST(coalesce(o.a, 0) AS DOUBLE) / (CAST(coalesce(i.a, 0) AS DOUBLE) + 1) AS ratio FROM (SELECT DISTINCT case_id, address AS node FROM ev_entities) e LEFT JOIN o USING (case_id, node) LEFT JOIN i USING (case_id, node)""")
def seed_node_features(t: Tables) -> DataFrame:
    rows = A.seed_features(t.dense, t.ev_entities.withColumnRenamed("address", "node"))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("out_amount", "max_out", "in_amount")})


@query("max_outflow_source", """WITH s AS (SELECT case_id, src, max(amount) AS mx, sum(amount) AS total, count(*) AS n FROM dense GROUP BY ALL) SELECT case_id, src, CAST(row_number() OVER (PARTITION BY case_id ORDER BY mx DESC, total DESC, n DESC, src) AS INTEGER) AS rank, CAST(mx AS DOUBLE) / CAST(max(mx) OVER (PARTITION BY case_id) AS DOUBLE) AS probability FROM s""")
def max_outflow_source(t: Tables) -> DataFrame:
    return policies.max_outflow_scores(t.dense).select("case_id", "src", "rank", "probability")


@query("merge_mappings", """SELECT case_id, chain, address, role, list(DISTINCT entity_id ORDER BY entity_id) AS evidence, min(confidence) AS confidence, min(pos) AS from_block, max(pos) + 10 AS to_block, count(*) AS n_mappings FROM ev_entities GROUP BY ALL""")
def merge_mappings(t: Tables) -> DataFrame:
    rows = t.ev_entities.select("case_id", "chain", "address", "role", F.array("entity_id").alias("evidence"), "confidence", F.col("pos").alias("from_block"), (F.col("pos") + 10).alias("to_block"))
    return E.merge_mappings(rows)


@query("attribution_audit", """WITH a AS (SELECT case_id, address, count(DISTINCT entity_id) AS n FROM ev_entities GROUP BY ALL), s AS (SELECT DISTINCT case_id, src FROM dense) SELECT a.case_id, count(*) AS n_addresses, count(*) FILTER (n > 1) AS n_conflicts, count(s.src) AS n_observed FROM a LEFT JOIN s ON a.case_id = s.case_id AND a.address = s.src GROUP BY a.case_id""")
def attribution_audit(t: Tables) -> DataFrame:
    seen = t.dense.select("case_id", F.col("src").alias("address"), F.lit(1).alias("seen")).distinct()
    return E.attribution(t.ev_entities).join(seen, ["case_id", "address"], "left").groupBy("case_id").agg(F.count("*").alias("n_addresses"), F.count_if(F.col("n_entities") > 1).alias("n_conflicts"), F.count("seen").alias("n_observed"))


@query("run_summary", """SELECT o_orderpriority AS task_type, 'passed' AS metric, avg(CAST(o_totalprice > 200000 AS INTEGER)) AS mean, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT o_orderpriority, 'price', CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS DOUBLE), count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def run_summary(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus != 'P'").select(F.col("o_orderpriority").alias("task_type"), (F.col("o_totalprice") > 200000).cast("int").alias("passed"), F.col("o_totalprice").alias("price"))
    return A.metric_means(rows, ["task_type"], ["passed", "price"])


@query("eval_summary", """SELECT coalesce(o_orderpriority, 'all') AS task_type, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_passed, count(*) FILTER (o_orderstatus = 'P') AS n_errors FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def eval_summary(t: Tables) -> DataFrame:
    rows = t.orders.rollup("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_passed"), F.count_if(F.col("o_orderstatus") == "P").alias("n_errors"))
    return rows.select(F.coalesce("o_orderpriority", F.lit("all")).alias("task_type"), "n", "n_passed", "n_errors")


@query("token_totals", """SELECT coalesce(role, 'all') AS role, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens, count(*) AS n FROM conversations GROUP BY GROUPING SETS ((role), ())""")
def token_totals(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("tokens", F.size(F.split("text", " ")).cast("long"))
    return rows.rollup("role").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).withColumn("role", F.coalesce("role", F.lit("all")))


@query("degree_roles", """SELECT case_id, address, CAST(sum(o) AS BIGINT) AS n_out, CAST(count(*) - sum(o) AS BIGINT) AS n_in, CASE WHEN count(*) = sum(o) THEN 'source' WHEN sum(o) = 0 THEN 'sink' ELSE 'intermediary' END AS role FROM (SELECT case_id, src AS address, 1 AS o FROM ev_edges UNION ALL SELECT case_id, dst, 0 FROM ev_edges) x GROUP BY ALL""")
def degree_roles(t: Tables) -> DataFrame:
    return A.degree_roles(t.ev_edges)


@query("sheet_time_window", """SELECT case_id, min(ts) AS start_ts, max(ts) AS end_ts FROM dense GROUP BY case_id""")
def sheet_time_window(t: Tables) -> DataFrame:
    return t.dense.groupBy("case_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("merge_key_fields", """SELECT case_id, arg_min(role, pos) FILTER (role <> 'router') AS first_role, list(DISTINCT chain ORDER BY chain) AS chains FROM ev_entities GROUP BY case_id""")
def merge_key_fields(t: Tables) -> DataFrame:
    value = C.non_empty(F.when(F.col("role") == "router", "").otherwise(F.col("role")))
    return t.ev_entities.groupBy("case_id").agg(F.min_by(value, F.when(value.isNotNull(), F.col("pos"))).alias("first_role"), F.array_sort(F.collect_set("chain")).alias("chains"))


@query("sources_used", """SELECT url, CASE WHEN run = 0 THEN 'visited' ELSE 'not_visited' END AS state FROM report_docs""")
def sources_used(t: Tables) -> DataFrame:
    findings = t.report_docs.where("run = 0").select("url", F.lit("visited").alias("state"))
    rest = t.report_docs.join(findings, "url", "left_anti").select("url", F.lit("not_visited").alias("state"))
    return findings.unionByName(rest)


@query("highest_grade", """SELECT o_orderkey AS fact, CASE WHEN min(grade) > 'D' THEN 'U' ELSE min(grade) END AS grade FROM orders JOIN ev_sources ON pos IN (o_orderkey % 25, o_custkey % 25) GROUP BY 1""")
def highest_grade(t: Tables) -> DataFrame:
    facts = t.orders.select(F.col("o_orderkey").alias("fact"), F.explode(F.array(F.col("o_orderkey") % 25, F.col("o_custkey") % 25)).alias("pos"))
    rows = facts.join(F.broadcast(t.ev_sources), "pos")
    best = rows.groupBy("fact").agg(F.min_by("grade", C.grade_rank("grade")).alias("grade"))
    return best.withColumn("grade", F.when(F.col("grade").isin(*"ABCD"), F.col("grade")).otherwise("U"))


@query("six_stats", """SELECT event_type, max(value) AS max, min(value) AS min, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, sum(value) AS sum FROM events GROUP BY event_type""")
def six_stats(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*A.six_stats("value"))


@query("gini", """WITH d AS (SELECT case_id, dst, sum(amount)::DOUBLE AS v FROM dense GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY v) AS i FROM d) SELECT case_id, least(1.0, greatest(0.0, 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*))) AS gini FROM r GROUP BY case_id""")
def gini(t: Tables) -> DataFrame:
    daily = t.dense.groupBy("case_id", "dst").agg(F.sum("amount").cast("double").alias("v"))
    return A.gini(daily, ["case_id"], "v")


@query("link_pair_summary", """SELECT case_id, src, dst, list(reported_id ORDER BY reported_id) AS edge_ids, list(DISTINCT stage ORDER BY stage) AS stages, CASE WHEN bool_and(verification_status = 'chain_verified') THEN 'chain_direct' ELSE 'reported' END AS semantics FROM ev_edges GROUP BY ALL""")
def link_pair_summary(t: Tables) -> DataFrame:
    return t.ev_edges.groupBy("case_id", "src", "dst").agg(F.array_sort(F.collect_list("reported_id")).alias("edge_ids"), F.array_sort(F.collect_set("stage")).alias("stages"), F.when(F.bool_and(F.col("verification_status") == "chain_verified"), "chain_direct").otherwise("reported").alias("semantics"))


@query("query_stats", """SELECT event_type, count(*) AS n, count(*) FILTER (value > 20) AS n_slow FROM events GROUP BY event_type""")
def query_stats(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("n_slow"))


@query("case_doc_profile", """SELECT case_id, 'entity' AS kind, count(*) AS n FROM ev_entities GROUP BY case_id UNION ALL SELECT case_id, 'edge', count(*) FROM ev_edges GROUP BY case_id""")
def case_doc_profile(t: Tables) -> DataFrame:
    from .scalars import flatten_docs

    return flatten_docs(t).where("case_id != 'all'").groupBy("case_id", "kind").agg(F.count("*").alias("n"))
