"""Queries of labelling rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evidence as E
from ..operators import labelling as L
from ..registry import query
from ..views import Tables
from .joins import reported_pairs, seeds

_LABELS = """lab AS (SELECT d.case_id, d.edge_id, d.src, d.dst, d.tx_hash, d.asset, d.edge_type, d.amount, coalesce(a.reported_id, b.reported_id) AS reported_id,
  CASE WHEN a.reported_id IS NOT NULL OR b.reported_id IS NOT NULL OR t.src IS NOT NULL THEN 'positive' WHEN s1.node IS NOT NULL OR s2.node IS NOT NULL THEN 'hard_negative' ELSE 'negative' END AS label, w.role, w.n
  FROM dense d LEFT JOIN rp a ON a.case_id = d.case_id AND a.src = d.src AND a.dst = d.dst LEFT JOIN rp b ON b.case_id = d.case_id AND b.src = d.dst AND b.dst = d.src
  LEFT JOIN tp t ON t.case_id = d.case_id AND t.src = d.src AND t.dst = d.dst LEFT JOIN sd s1 ON s1.case_id = d.case_id AND s1.node = d.src LEFT JOIN sd s2 ON s2.case_id = d.case_id AND s2.node = d.dst
  LEFT JOIN wh w ON w.case_id = d.case_id AND w.address = d.dst),
 act AS (SELECT *, CASE WHEN label <> 'positive' THEN 'ignore' WHEN n > 1 THEN 'inspect' WHEN role IN ('exchange_deposit', 'mixer') THEN 'stop' WHEN role IN ('router', 'bridge') THEN 'inspect' ELSE 'follow' END AS action FROM lab)"""
LABEL_CTES = f"""rp AS (SELECT case_id, src, dst, max(reported_id) AS reported_id FROM ev_edges GROUP BY ALL), tp AS (SELECT DISTINCT case_id, src, dst FROM ev_edges WHERE stage = 'theft'), sd AS (SELECT DISTINCT case_id, address AS node FROM ev_entities WHERE role = 'attacker_wallet'), wh AS (SELECT case_id, address, count(DISTINCT entity_id) AS n, arg_min(role, entity_id) AS role FROM ev_entities GROUP BY ALL), {_LABELS}"""


def outflow_pairs(t: Tables) -> DataFrame:
    return E.positive_pairs(t.ev_edges.withColumn("label", F.when(F.col("stage") == "theft", "attacker_outflow").otherwise("")))


def labelled(t: Tables) -> DataFrame:
    return L.label_edges(t.dense, outflow_pairs(t), reported_pairs(t), seeds(t), E.attribution(t.ev_entities))


@query("label_edges", f"WITH {LABEL_CTES} SELECT edge_id, label, action, CASE WHEN label = 'positive' THEN 'B' ELSE 'C' END AS confidence FROM act UNION ALL SELECT 'reported:' || reported_id, 'reported_positive', 'inspect', confidence FROM ev_edges WHERE verification_status <> 'chain_verified'")
def label_edges(t: Tables) -> DataFrame:
    return labelled(t).unionByName(L.reported_labels(t.ev_edges)).select("edge_id", "label", "action", "confidence")


@query("classify_action", f"WITH {LABEL_CTES} SELECT case_id, label, action, count(*) AS n FROM act GROUP BY ALL")
def classify_action(t: Tables) -> DataFrame:
    return labelled(t).groupBy("case_id", "label", "action").agg(F.count("*").alias("n"))


@query("classify_tx_rules", """WITH sd AS (SELECT DISTINCT case_id, address AS node FROM ev_entities WHERE role = 'attacker_wallet'), r AS (SELECT d.edge_id, list_filter([CASE WHEN s.node IS NOT NULL AND token_address IS NULL AND amount > 0 AND amount <= 20000 THEN 'attacker_small_outflow' END, CASE WHEN s.node IS NOT NULL AND token_address IS NULL AND amount >= 50000 THEN 'attacker_large_outflow' END, CASE WHEN s.node IS NOT NULL AND token_address IS NOT NULL THEN 'attacker_token_outflow' END, CASE WHEN i.node IS NOT NULL THEN 'attacker_inbound_funding' END], lambda x: x IS NOT NULL) AS labels FROM dense d LEFT JOIN sd s ON s.case_id = d.case_id AND s.node = d.src LEFT JOIN sd i ON i.case_id = d.case_id AND i.node = d.dst)
 SELECT edge_id, labels, coalesce(labels[1], 'unclassified') AS primary_label FROM r""")
def classify_tx_rules(t: Tables) -> DataFrame:
    return L.tx_rules(t.dense, seeds(t), 20000, 50000).select("edge_id", "labels", "primary_label")


_REC = """WITH wh AS (SELECT case_id, address, arg_min(role, entity_id) AS role FROM ev_entities GROUP BY ALL) SELECT e.reported_id, CASE WHEN role = 'mixer' THEN 'stop_at_mixer' WHEN role = 'exchange_deposit' THEN 'request_exchange_records' WHEN role IN ('router', 'bridge') THEN 'decode_contract_call' WHEN verification_status <> 'chain_verified' THEN 'verify_on_chain' WHEN stage = 'cash_out' THEN 'check_destination' ELSE 'continue_tracing' END AS recommended, verification_status = 'chain_verified' AND confidence <> 'C' AS gt_usable FROM ev_edges e LEFT JOIN wh ON wh.case_id = e.case_id AND wh.address = e.dst"""


@query("recommended_action", _REC)
def recommended_action(t: Tables) -> DataFrame:
    who = E.attribution(t.ev_entities).select("case_id", F.col("address").alias("dst"), "role")
    rows = t.ev_edges.withColumn("verified", F.col("verification_status") == "chain_verified").join(who, ["case_id", "dst"], "left")
    return rows.select("reported_id", L.recommended_action("role", "stage", "verified").alias("recommended"), (F.col("verified") & (F.col("confidence") != "C")).alias("gt_usable"))
