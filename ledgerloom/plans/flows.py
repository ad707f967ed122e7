"""The flagship: taint of each case's largest senders, allotted first in, first out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import policies
from ..registry import query
from ..views import Tables

_SUMMARY = """WITH t AS (SELECT case_id, src, edge_id, ts, block_number, coalesce(token_address, asset) AS bucket, amount AS amt FROM dense),
 src_stats AS (SELECT case_id, src, max(amt) AS mx, sum(amt) AS total, count(*) AS n FROM t GROUP BY case_id, src),
 active AS (SELECT case_id, src FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY mx DESC, total DESC, n DESC, src) AS rn FROM src_stats) x WHERE rn <= 10),
 w AS (SELECT t.*, 0.5 * sum(amt) OVER (PARTITION BY t.case_id, t.src, bucket) AS budget,
  coalesce(sum(amt) OVER (PARTITION BY t.case_id, t.src, bucket ORDER BY ts, block_number, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM t JOIN active a ON t.case_id = a.case_id AND t.src = a.src),
 s AS (SELECT *, greatest(0, least(amt, budget - spent)) AS allocated FROM w)
SELECT case_id, count(*) AS edges, CAST(sum(CASE WHEN allocated >= 0.5 * amt THEN 1 ELSE 0 END) AS BIGINT) AS follow_edges, CAST(sum(allocated) AS DOUBLE) AS tainted_amount FROM s GROUP BY case_id"""


def active_sources(t: Tables, n: int = 10) -> DataFrame:
    return policies.max_outflow_sources(t.dense, n).select("case_id", F.col("src").alias("node"))


@query("taint_fifo_summary", _SUMMARY)
def taint_fifo_summary(t: Tables) -> DataFrame:
    edges = t.dense.select("case_id", "src", "edge_id", "ts", "block_number", "token_address", "asset", "edge_type", "amount")
    scored = policies.taint(edges, active_sources(t), "fifo", 0.5).where("active")
    follow = F.sum(F.when(F.col("allocated") >= F.col("amount") * F.lit("0.5").cast("decimal(2,1)"), 1).otherwise(0))
    return scored.groupBy("case_id").agg(F.count("*").alias("edges"), follow.alias("follow_edges"), F.sum("allocated").cast("double").alias("tainted_amount"))
