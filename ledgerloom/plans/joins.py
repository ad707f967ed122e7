"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import relational
from ..registry import query
from ..views import Tables


@query("label_edge_join", """SELECT d.edge_id, d.case_id, r.stage AS label FROM dense d LEFT JOIN ev_edges r ON d.case_id = r.case_id AND 'R' || substr(d.edge_id, 5) = r.reported_id""")
def label_edge_join(t: Tables) -> DataFrame:
    labels = t.ev_edges.select("case_id", "reported_id", F.col("stage").alias("label"))
    return t.dense.withColumn("reported_id", F.expr("concat('R', substr(edge_id, 5))")).join(labels, ["case_id", "reported_id"], "left").select("edge_id", "case_id", "label")


_RESOLVE = """WITH r AS (SELECT e.case_id, e.reported_id, coalesce(a.entity_id, e.src) AS src, e.dst FROM ev_edges e LEFT JOIN (SELECT case_id, address, min(entity_id) AS entity_id FROM ev_entities GROUP BY ALL) a ON a.case_id = e.case_id AND a.address = e.src)
 SELECT r.case_id, r.reported_id, coalesce(x.address, CASE WHEN r.src LIKE '0x%' THEN r.src END) AS src_address, coalesce(y.address, r.dst) AS dst_address FROM r LEFT JOIN ev_entities x ON x.case_id = r.case_id AND x.entity_id = r.src LEFT JOIN ev_entities y ON y.case_id = r.case_id AND y.entity_id = r.dst"""


@query("resolve_reported_edges", _RESOLVE)
def resolve_reported_edges(t: Tables) -> DataFrame:
    named = t.ev_entities.groupBy("case_id", F.col("address").alias("src")).agg(F.min("entity_id").alias("entity_id"))
    reported = t.ev_edges.join(named, ["case_id", "src"], "left").withColumn("src", F.coalesce("entity_id", "src"))
    return E.resolve_reported(reported.select("case_id", "reported_id", "src", "dst"), t.ev_entities.select("case_id", "entity_id", "address")).select("case_id", "reported_id", "src_address", "dst_address")


@query("positive_pairs", """SELECT DISTINCT case_id, src, dst FROM ev_edges WHERE stage = 'theft'""")
def positive_pairs(t: Tables) -> DataFrame:
    label = F.when(F.col("stage") == "theft", "Attacker_outflow").otherwise(F.col("stage"))
    return E.positive_pairs(t.ev_edges.withColumn("label", label))


_LAST = "p AS (SELECT case_id, src, dst, arg_max(reported_id, reported_id) AS reported_id FROM ev_edges GROUP BY ALL)"


def reported_pairs(t: Tables) -> DataFrame:
    """One reported id by pair: the last of repeated ones."""
    return t.ev_edges.groupBy("case_id", "src", "dst").agg(F.max("reported_id").alias("reported_id"))


@query("pair_or_reverse_join", f"""WITH {_LAST} SELECT d.edge_id, coalesce(a.reported_id, b.reported_id) AS reported_id FROM dense d LEFT JOIN p a ON a.case_id = d.case_id AND a.src = d.src AND a.dst = d.dst LEFT JOIN p b ON b.case_id = d.case_id AND b.src = d.dst AND b.dst = d.src""")
def pair_or_reverse_join(t: Tables) -> DataFrame:
    return E.pair_or_reverse(t.dense, reported_pairs(t), "reported_id").select("edge_id", "reported_id")


@query("touches_seed", """SELECT edge_id, (case_id, src) IN (SELECT (case_id, address) FROM ev_entities WHERE role = 'attacker_wallet') OR (case_id, dst) IN (SELECT (case_id, address) FROM ev_entities WHERE role = 'attacker_wallet') AS touches_seed FROM dense""")
def touches_seed(t: Tables) -> DataFrame:
    return E.touches(t.dense, seeds(t)).select("edge_id", "touches_seed")


def seeds(t: Tables) -> DataFrame:
    return t.ev_entities.where("role = 'attacker_wallet'").select("case_id", F.col("address").alias("node"))


@query("service_attribution", """WITH a AS (SELECT case_id, address, count(DISTINCT entity_id) AS n_entities, arg_min(role, entity_id) AS role FROM ev_entities GROUP BY ALL)
 SELECT d.edge_id, a.role, a.n_entities > 1 AS conflict FROM dense d JOIN a ON a.case_id = d.case_id AND a.address = d.dst""")
def service_attribution(t: Tables) -> DataFrame:
    who = E.attribution(t.ev_entities).withColumnRenamed("address", "dst")
    return t.dense.join(who, ["case_id", "dst"]).select("edge_id", "role", (F.col("n_entities") > 1).alias("conflict"))


_MATCH = """SELECT r.reported_id, d.edge_id AS tx_edge, list_filter([CASE WHEN r.src = d.src AND r.dst = d.dst THEN 'same_pair' END, CASE WHEN r.src = d.dst AND r.dst = d.src THEN 'reverse_pair' END, CASE WHEN r.src = d.src THEN 'same_source' END, CASE WHEN r.asset = d.asset THEN 'same_asset' END, CASE WHEN r.amount = d.amount THEN 'same_amount' END], lambda x: x IS NOT NULL) AS reasons
 FROM ev_edges r JOIN dense d ON r.case_id = d.case_id AND CAST(abs(d.amount - r.amount) AS DOUBLE) <= CAST(r.amount AS DOUBLE) * 0.01"""


@query("report_tx_theta_join", f"SELECT reported_id, tx_edge FROM ({_MATCH}) x")
def report_tx_theta_join(t: Tables) -> DataFrame:
    return E.match_transactions(t.ev_edges.select("case_id", "reported_id", "src", "dst", "asset", "amount"), t.dense).select("reported_id", "tx_edge")


@query("edge_match_reasons", f"SELECT * FROM ({_MATCH}) x WHERE len(reasons) > 0")
def edge_match_reasons(t: Tables) -> DataFrame:
    return E.reasoned_matches(t.ev_edges.select("case_id", "reported_id", "src", "dst", "asset", "amount"), t.dense).select("reported_id", "tx_edge", "reasons")


@query("scanner_label_join", """SELECT e.entity_id, n.n_name AS label FROM ev_entities e JOIN nation n ON e.pos % 25 = n.n_nationkey""")
def scanner_label_join(t: Tables) -> DataFrame:
    alias = t.nation.select(F.lower("n_name").alias("alias"), F.col("n_name").alias("label"), "n_nationkey")
    named = t.ev_entities.join(t.nation, F.col("pos") % 25 == F.col("n_nationkey")).select("entity_id", F.concat(F.lit("Binance "), "n_name", F.lit(": hot wallet")).alias("text"))
    # The aliases are a short, fixed list; a label holds an alias as whole words.
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), F.lit(" "))
    return named.join(F.broadcast(alias), F.contains(words, F.concat(F.lit(" "), F.regexp_replace("alias", "[^a-z0-9]+", " "), F.lit(" ")))).select("entity_id", "label")


@query("missing_references", """SELECT DISTINCT case_id, n AS address, 'address' AS type FROM (SELECT case_id, src AS n FROM ev_edges UNION ALL SELECT case_id, dst FROM ev_edges) x WHERE (case_id, n) NOT IN (SELECT (case_id, address) FROM ev_entities)""")
def missing_references(t: Tables) -> DataFrame:
    return E.missing_references(t.ev_edges, t.ev_entities)


@query("evidence_keyword_join", """SELECT report_id, source_id FROM (SELECT report_id, source_id, row_number() OVER (PARTITION BY report_id ORDER BY pos) AS rn FROM reports JOIN ev_sources ON contains(lower(finding), lower(victims[1])) WHERE grade IN ('A', 'B', 'C', 'D')) x WHERE rn <= 5""")
def evidence_keyword_join(t: Tables) -> DataFrame:
    words = t.reports.select("report_id", F.col("victims")[0].alias("keyword"))
    return E.keyword_sources(words, F.broadcast(t.ev_sources.where("grade in ('A', 'B', 'C', 'D')")), "keyword", "finding").select("report_id", "source_id")


@query("source_support_join", """SELECT o_orderkey AS fact, list(s.entity ORDER BY s.source_id) AS entities, min(s.grade) AS best FROM orders JOIN ev_sources s ON s.pos IN (o_orderkey % 25, (o_orderkey + 7) % 25) GROUP BY 1""")
def source_support_join(t: Tables) -> DataFrame:
    facts = t.orders.select(F.col("o_orderkey").alias("fact"), F.explode(F.array(F.col("o_orderkey") % 25, (F.col("o_orderkey") + 7) % 25)).alias("pos"))
    rows = facts.join(F.broadcast(t.ev_sources), "pos").groupBy("fact").agg(F.sort_array(F.collect_list(F.struct("source_id", "entity"))).alias("s"), F.min("grade").alias("best"))
    return rows.select("fact", F.col("s.entity").alias("entities"), "best")


@query("candidate_materialize", """SELECT case_id, src, dst, sum(amount)::DOUBLE AS amount, count(*) AS n_edges, min(ts) AS min_ts, max(ts) AS max_ts FROM dense WHERE priority = '2-HIGH' GROUP BY case_id, src, dst""")
def candidate_materialize(t: Tables) -> DataFrame:
    rows = t.dense.where("priority = '2-HIGH'")
    groups = rows.groupBy("case_id", "src", "dst").agg(F.collect_set("edge_id").alias("members"))
    # Groups of edge ids, as tasks hold them, back to their edges.
    ids = groups.select("case_id", F.explode("members").alias("edge_id"))
    return ids.join(t.dense, ["case_id", "edge_id"], "left").groupBy("case_id", "src", "dst").agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("n_edges"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


@query("task_edge_docs", """SELECT edge_id, CASE WHEN edge_type = 0 THEN 'edge' WHEN status = 'F' THEN 'summary' ELSE 'id' END AS origin, CASE WHEN edge_type = 0 OR status = 'F' THEN src END AS src FROM dense""")
def task_edge_docs(t: Tables) -> DataFrame:
    ids = t.dense.select("edge_id")
    full = t.dense.where("edge_type = 0").select("edge_id", F.col("src").alias("s1"))
    brief = t.dense.where("status = 'F'").select("edge_id", F.col("src").alias("s2"))
    out = ids.join(full, "edge_id", "left").join(brief, "edge_id", "left")
    return out.select("edge_id", F.when(F.col("s1").isNotNull(), "edge").when(F.col("s2").isNotNull(), "summary").otherwise("id").alias("origin"), F.coalesce("s1", "s2").alias("src"))


@query("two_hop_paths", """SELECT case_id, e1 AS first_edge, e2 AS second_edge FROM (SELECT a.case_id, a.reported_id AS e1, b.reported_id AS e2, row_number() OVER (PARTITION BY a.case_id, a.reported_id ORDER BY b.ts, b.reported_id) AS rn FROM ev_edges a JOIN ev_edges b ON a.case_id = b.case_id AND a.dst = b.src AND b.ts >= a.ts AND a.reported_id <> b.reported_id) x WHERE rn = 1""")
def two_hop_paths(t: Tables) -> DataFrame:
    return E.two_hop_paths(t.ev_edges.withColumnRenamed("reported_id", "edge_id"))


@query("stage_sequence_pairs", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id, src ORDER BY ts, reported_id) AS i FROM ev_edges) SELECT case_id, e1, e2 FROM (SELECT a.case_id, a.reported_id AS e1, b.reported_id AS e2, row_number() OVER (PARTITION BY a.case_id ORDER BY a.src, a.i, b.i) AS n FROM r a JOIN r b ON a.case_id = b.case_id AND a.src = b.src AND a.i < b.i AND a.stage <> b.stage) x WHERE n <= 24""")
def stage_sequence_pairs(t: Tables) -> DataFrame:
    return E.stage_sequences(t.ev_edges)


@query("legacy_path_pairs", """WITH p AS (SELECT * FROM ev_edges WHERE stage = 'theft') SELECT case_id, e1, e2 FROM (SELECT a.case_id, a.reported_id AS e1, b.reported_id AS e2, row_number() OVER (PARTITION BY a.case_id, a.reported_id ORDER BY sha256(a.reported_id || '|' || b.reported_id)) AS rn FROM p a JOIN p b ON a.case_id = b.case_id AND a.dst = b.src AND a.reported_id <> b.reported_id) x WHERE rn <= 3""")
def legacy_path_pairs(t: Tables) -> DataFrame:
    p = t.ev_edges.where("stage = 'theft'")
    both = p.select("case_id", F.col("reported_id").alias("e1"), F.col("dst").alias("n")).join(p.select("case_id", F.col("reported_id").alias("e2"), F.col("src").alias("n")), ["case_id", "n"]).where("e1 != e2")
    return relational.top_n_per_group(both, ["case_id", "e1"], [relational.hash_order("e1", "e2")], 3).select("case_id", "e1", "e2")


@query("reconcile_entities", """SELECT entity_id, CASE WHEN pos % 4 = 0 THEN 'unverifiable' WHEN pos % 6 = 1 OR pos % 6 = 5 THEN 'discrepancy' ELSE 'confirmed' END AS status FROM ev_entities""")
def reconcile_entities(t: Tables) -> DataFrame:
    stored = t.ev_entities.select("entity_id", "role", F.col("pos").alias("k"))
    fresh = stored.where("k % 4 != 0").withColumn("role", F.when(F.col("k") % 6 == 1, "other").otherwise(F.col("role"))).withColumn("k", F.when(F.col("k") % 6 == 5, -1).otherwise(F.col("k")))
    return E.reconcile(stored, fresh, "entity_id", ["role", "k"]).select("entity_id", "status")


@query("reconcile_edges", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN edge_type = 1 THEN 'unverifiable' WHEN asset = 'A' THEN 'discrepancy' ELSE 'confirmed' END AS status FROM dense) x GROUP BY 1""")
def reconcile_edges(t: Tables) -> DataFrame:
    stored = t.dense.select("edge_id", "src", "dst")
    fresh = t.dense.where("edge_type = 0").select("edge_id", "src", F.when(F.col("asset") == "A", "0x0").otherwise(F.col("dst")).alias("dst"))
    return E.reconcile(stored, fresh, "edge_id", ["src", "dst"]).groupBy("status").agg(F.count("*").alias("n"))


@query("select_cases", """SELECT c_custkey AS pos, c_name AS case_dir FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)""")
def select_cases(t: Tables) -> DataFrame:
    allowed = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("case_dir"))
    there = t.orders.select(F.col("o_custkey").alias("pos")).distinct().join(t.customer.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("case_dir")), "pos").select("case_dir")
    return allowed.join(there, "case_dir", "left_semi").select("pos", "case_dir").orderBy("pos")


@query("resolve_profiles", """SELECT o_orderkey AS task, CASE WHEN native THEN 'native' ELSE 'projected' END AS origin FROM (SELECT *, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) = 1 AS native FROM orders) x WHERE (native AND o_orderpriority = '1-URGENT') OR (NOT native AND o_orderstatus <> 'P')""")
def resolve_profiles(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.orders.select(F.col("o_custkey").alias("case_key"), F.col("o_orderkey").alias("task"), (F.col("o_orderpriority") == "1-URGENT").alias("asked"), (F.col("o_orderstatus") != "P").alias("projectable"))
    native = F.max("asked").over(Window.partitionBy("case_key"))
    rows = rows.withColumn("native", native).where("(native and asked) or (not native and projectable)")
    return rows.select("task", F.when(F.col("native"), "native").otherwise("projected").alias("origin"))


@query("line_graph", """WITH d AS (SELECT case_id, reported_id AS e, src, dst FROM ev_edges), n AS (SELECT case_id, e, src AS n FROM d UNION SELECT case_id, e, dst FROM d), p AS (SELECT DISTINCT a.case_id, a.e AS e1, b.e AS e2 FROM n a JOIN n b ON a.case_id = b.case_id AND a.n = b.n), g AS (SELECT case_id, e1, count(*) AS k FROM p GROUP BY ALL)
 SELECT p.case_id, p.e1, p.e2, 1 / sqrt(x.k * y.k) AS weight FROM p JOIN g x ON x.case_id = p.case_id AND x.e1 = p.e1 JOIN g y ON y.case_id = p.case_id AND y.e1 = p.e2""")
def line_graph(t: Tables) -> DataFrame:
    return E.line_graph(t.ev_edges.withColumnRenamed("reported_id", "edge_id"))


@query("temporal_line_graph", """WITH d AS (SELECT case_id, reported_id AS e, src, dst, ts FROM ev_edges), p AS (SELECT DISTINCT a.case_id, a.e AS e1, b.e AS e2 FROM d a JOIN d b ON a.case_id = b.case_id AND ((b.dst = a.src AND b.ts <= a.ts) OR a.e = b.e))
 SELECT case_id, e1, e2, 1.0 / count(*) OVER (PARTITION BY case_id, e1) AS weight FROM p""")
def temporal_line_graph(t: Tables) -> DataFrame:
    return E.line_graph(t.ev_edges.withColumnRenamed("reported_id", "edge_id"), directed=True)


@query("node_rows_for_task", """SELECT case_id, address AS node, count(edge_id) AS n_out FROM (SELECT DISTINCT case_id, address FROM ev_entities) e LEFT JOIN dense d USING (case_id) WHERE d.src = e.address GROUP BY ALL""")
def node_rows_for_task(t: Tables) -> DataFrame:
    features = t.dense.groupBy("case_id", F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    return t.ev_entities.select("case_id", F.col("address").alias("node")).distinct().join(features, ["case_id", "node"])


@query("protocol_cover_join", """SELECT case_id, src, count(DISTINCT dst) AS n_groups, count(DISTINCT CASE WHEN status = 'F' THEN dst END) AS n_covered FROM dense GROUP BY case_id, src""")
def protocol_cover_join(t: Tables) -> DataFrame:
    groups = t.dense.select("case_id", "src", "dst", "edge_id")
    calls = t.dense.where("status = 'F'").select("case_id", "edge_id")
    covered = groups.join(calls, ["case_id", "edge_id"], "left_semi").select("case_id", "src", "dst").distinct()
    n = groups.groupBy("case_id", "src").agg(F.count_distinct("dst").alias("n_groups"))
    return n.join(covered.groupBy("case_id", "src").agg(F.count("*").alias("n_covered")), ["case_id", "src"], "left").select("case_id", "src", "n_groups", F.coalesce("n_covered", F.lit(0)).alias("n_covered"))


@query("case_graph_edges", """SELECT edge_id, case_id, src, dst, 1 AS edge_count, 1 AS tx_count, [asset] AS assets, CASE WHEN token_address IS NULL THEN [] ELSE [token_address] END AS tokens FROM dense WHERE case_id IN (SELECT case_id FROM ev_edges)""")
def case_graph_edges(t: Tables) -> DataFrame:
    rows = t.dense.join(t.ev_edges.select("case_id").distinct(), "case_id", "left_semi").where("src is not null and dst is not null")
    return rows.select("edge_id", "case_id", "src", "dst", F.lit(1).alias("edge_count"), F.lit(1).alias("tx_count"), F.array("asset").alias("assets"), F.array_compact(F.array("token_address")).alias("tokens"))
