"""Queries of look-ups in the transfer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookup as L
from ..registry import query
from ..views import Tables

_REQ = "r AS (SELECT DISTINCT case_id, address FROM ev_entities)"


def _requests(t: Tables) -> DataFrame:
    return t.ev_entities.select("case_id", "address").distinct()


@query("neighbors", f"""WITH {_REQ}, n AS (SELECT r.case_id, r.address, d.edge_id, 'out' AS direction, d.block_number FROM r JOIN dense d ON d.case_id = r.case_id AND d.src = r.address UNION ALL SELECT r.case_id, r.address, d.edge_id, 'in', d.block_number FROM r JOIN dense d ON d.case_id = r.case_id AND d.dst = r.address)
 SELECT case_id, address, edge_id, direction FROM (SELECT *, row_number() OVER (PARTITION BY case_id, address ORDER BY block_number, edge_id, direction) AS rn FROM n WHERE block_number >= 7200 * 400) x WHERE rn <= 50""")
def neighbors(t: Tables) -> DataFrame:
    return L.neighbors(t.dense.where("block_number >= 7200 * 400"), _requests(t), limit=50).select("case_id", "address", "edge_id", "direction")


@query("complete_neighbors", f"""WITH {_REQ}, n AS (SELECT r.case_id, r.address, count(d.edge_id) AS n FROM r LEFT JOIN dense d ON d.case_id = r.case_id AND d.src = r.address GROUP BY ALL)
 SELECT case_id, address, least(n, 80) AS n_edges, n BETWEEN 1 AND 80 AS complete FROM n""")
def complete_neighbors(t: Tables) -> DataFrame:
    return L.complete_neighbors(t.dense, _requests(t), limit=80)


@query("node_lookup", f"""WITH {_REQ}, o AS (SELECT case_id, src AS address, count(*) AS n_out, sum(amount) AS v_out FROM dense GROUP BY ALL), i AS (SELECT case_id, dst AS address, count(*) AS n_in FROM dense GROUP BY ALL)
 SELECT case_id, address, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, CAST(coalesce(v_out, 0) AS DOUBLE) AS value_out, n_out IS NOT NULL OR n_in IS NOT NULL AS known FROM r LEFT JOIN o USING (case_id, address) LEFT JOIN i USING (case_id, address)""")
def node_lookup(t: Tables) -> DataFrame:
    out = L.node_lookup(t.dense, _requests(t))
    return out.withColumn("value_out", F.col("value_out").cast("double"))


_KHOP = """WITH RECURSIVE e AS (SELECT DISTINCT case_id, src, dst FROM transfers WHERE status = 'F'), seeds AS (SELECT DISTINCT case_id, address AS node FROM ev_entities),
 walk(case_id, node, hop) AS (SELECT case_id, node, 0 FROM seeds UNION SELECT e.case_id, CASE WHEN e.src = w.node THEN e.dst ELSE e.src END, w.hop + 1 FROM walk w JOIN e ON e.case_id = w.case_id AND (e.src = w.node OR e.dst = w.node) WHERE w.hop < 2),
 first AS (SELECT case_id, node, min(hop) AS hop FROM walk GROUP BY case_id, node)
 SELECT t.case_id, t.edge_id, 1 + min(f.hop) AS hop FROM transfers t JOIN first f ON f.case_id = t.case_id AND (f.node = t.src OR f.node = t.dst) WHERE t.status = 'F' AND f.hop < 2 GROUP BY ALL"""


@query("expand_k_hop", _KHOP)
def expand_k_hop(t: Tables) -> DataFrame:
    seeds = t.ev_entities.select("case_id", F.col("address").alias("node")).distinct()
    return L.expand_k_hop(t.transfers.where("status = 'F'"), seeds, k=2).select("case_id", "edge_id", "hop")


@query("hydrate_edges", """SELECT d.edge_id, CASE WHEN edge_type = 0 THEN amount END AS amount, 1 AS hop, CASE WHEN edge_type = 0 THEN tx_hash ELSE 'partial' END AS tx_hash FROM dense d""")
def hydrate_edges(t: Tables) -> DataFrame:
    walked = t.dense.select("edge_id", F.lit(None).cast("decimal(18,4)").alias("amount"), F.lit(1).alias("hop"), F.lit("partial").alias("tx_hash"))
    full = t.dense.where("edge_type = 0").select("edge_id", "amount", F.lit(9).alias("hop"), "tx_hash")
    return L.hydrate(walked, full)


@query("address_sample_neighbors", """SELECT e.entity_id, count(x.edge_id) AS n_sample, min(x.edge_id) AS first_edge FROM ev_entities e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY case_id, src ORDER BY block_number, edge_id) AS rn FROM dense) x ON x.case_id = e.case_id AND x.src = e.address AND rn <= 5 GROUP BY e.entity_id""")
def address_sample_neighbors(t: Tables) -> DataFrame:
    found = L.neighbors(t.dense, _requests(t), limit=5, direction="out")
    return t.ev_entities.join(found, ["case_id", "address"], "left").groupBy("entity_id").agg(F.count("edge_id").alias("n_sample"), F.min("edge_id").alias("first_edge"))


@query("transaction_tool_summary", f"""SELECT case_id, src, dst, edge_type, count(DISTINCT edge_id) AS n_edges, list(DISTINCT tx_hash ORDER BY tx_hash) AS hashes FROM dense WHERE block_number BETWEEN 7200 * 1000 AND 7200 * 3000 AND (case_id, src) IN (SELECT (case_id, address) FROM ev_entities) GROUP BY ALL""")
def transaction_tool_summary(t: Tables) -> DataFrame:
    rows = t.dense.where("block_number between 7200 * 1000 and 7200 * 3000").join(_requests(t).withColumnRenamed("address", "src"), ["case_id", "src"], "left_semi")
    return rows.groupBy("case_id", "src", "dst", "edge_type").agg(F.count_distinct("edge_id").alias("n_edges"), F.sort_array(F.collect_set("tx_hash")).alias("hashes"))
