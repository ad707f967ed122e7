"""Queries of scans, sinks and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import query
from ..sources import files as S
from ..views import Tables


@query("scan_jsonl", """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def scan_jsonl(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "jsonl")
    S.write_jsonl(t.events.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")), path)
    good, _ = S.read_jsonl(t.spark, path, "event_id long, event_type string, k long")
    return good


@query("scan_case_documents", """SELECT case_id AS case_dir, count(DISTINCT stage) AS n_stages, true AS complete FROM ev_edges GROUP BY case_id""")
def scan_case_documents(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "cases")
    docs = t.ev_edges.groupBy("case_id").agg(F.count_distinct("stage").alias("n_stages"))
    for kind in ("summary", "evidence"):
        docs.select(F.col("case_id").alias("case_dir"), F.lit(kind).alias("artifact"), "n_stages").write.partitionBy("case_dir", "artifact").mode("append").json(path)
    rows = t.spark.read.schema("n_stages long, case_dir string, artifact string").json(path)
    return S.complete_cases(rows, ("summary", "evidence"))


_FOLDER = "CASE source_type WHEN 'forum' THEN '_skipped' WHEN 'audit' THEN '01-audit' ELSE '02-news' END"


@query("discover_documents", f"""SELECT * FROM (SELECT CASE WHEN grade IN ('A', 'B') THEN 'main' ELSE 'other' END AS namespace, {_FOLDER} AS case_dir, count(*) AS n_rows, true AS sized FROM report_docs GROUP BY ALL) x WHERE case_dir <> '_skipped'""")
def discover_documents(t: Tables) -> DataFrame:
    """Document files below a folder, by namespace and case folder, with the rows that they hold."""
    path = S.scratch(t.spark, "documents")
    rows = t.report_docs.select(F.when(F.col("grade").isin("A", "B"), "main").otherwise("other").alias("namespace"), F.expr(_FOLDER).alias("case_dir"), "url", "filename")
    rows.repartition("namespace", "case_dir").write.partitionBy("namespace", "case_dir").json(path)
    files = S.document_files(t.spark, path, "*.json")
    held = t.spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count("*").alias("n_rows"))
    return files.join(held, "path").groupBy("namespace", "case_dir").agg(F.sum("n_rows").alias("n_rows"), F.bool_and(F.col("n_bytes") > 0).alias("sized"))


_PATHS = """CASE WHEN page_id % 4 < 2 THEN 'cases' ELSE 'summarized' END || '/' || CASE WHEN page_id % 11 = 0 THEN '_old' WHEN page_id % 11 = 1 THEN 'xx-draft' ELSE 'case_' || CAST(page_id % 50 AS VARCHAR) END || CASE WHEN page_id % 13 = 0 THEN '/deep' ELSE '' END || '/' || CASE page_id % 4 WHEN 0 THEN 'case.json' WHEN 1 THEN 'run_' || CAST(page_id AS VARCHAR) || '.json' WHEN 2 THEN 'summary.json' ELSE CASE WHEN page_id % 3 = 0 THEN 'chain_evidence.json' ELSE 'case.json' END END"""


@query(
    "document_metadata",
    f"""WITH f AS (SELECT page_id, {_PATHS} AS path FROM pages), p AS (SELECT *, string_split(path, '/') AS x FROM f),
 d AS (SELECT *, CASE WHEN x[1] = 'cases' AND x[3] = 'case.json' THEN 'case_report_manifest' WHEN x[1] = 'summarized' AND x[3] = 'summary.json' THEN 'case_report_summary' WHEN x[1] = 'summarized' AND x[3] = 'chain_evidence.json' THEN 'chain_evidence' WHEN x[1] = 'cases' AND x[3] LIKE 'run%.json' THEN 'report_collection_run' END AS document_type FROM p WHERE len(x) = 3 AND NOT starts_with(x[2], '_') AND NOT x[2] LIKE 'xx-%')
 SELECT path, x[1] || '.' || regexp_replace(x[3], '[.][^.]*$', '') AS namespace, document_type, x[2] AS case_dir, CASE WHEN page_id % 5 > 1 THEN 'id_' || CAST(page_id AS VARCHAR) END AS case_id, CASE WHEN page_id % 5 > 2 THEN 'name' END AS case_name FROM d WHERE document_type IS NOT NULL""",
)
def document_metadata(t: Tables) -> DataFrame:
    """Type, case and namespace of a document a page; contents are objects with and without id and name, and other text."""
    content = F.expr("case page_id % 5 when 0 then html when 1 then '[1]' when 2 then to_json(named_struct('case_id', concat('id_', cast(page_id as string)), 'case_name', '')) else to_json(named_struct('case_id', concat('id_', cast(page_id as string)), 'case_name', 'name')) end")
    files = t.pages.select(F.expr(_PATHS.replace("VARCHAR", "STRING")).alias("path"), content.alias("content"))
    return S.case_documents(files, include_runs=True)


@query("sink_jsonl", """SELECT o_orderpriority AS case_dir, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def sink_jsonl(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "jsonl")
    S.write_jsonl(t.orders.select(F.col("o_orderpriority").alias("case_dir"), "o_orderkey", "o_totalprice"), path, ["case_dir"])
    return t.spark.read.schema("o_orderkey long, case_dir string").json(path).groupBy("case_dir").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "export_edge_table",
    """WITH l AS (SELECT edge_id, CASE WHEN edge_type = 0 AND priority = '1-URGENT' THEN 'positive' WHEN priority = '5-LOW' THEN 'hard_negative' ELSE 'negative' END AS label FROM dense),
 e AS (SELECT d.*, l.label FROM dense d LEFT JOIN l USING (edge_id)), black AS (SELECT DISTINCT case_id, n FROM (SELECT case_id, src AS n FROM e WHERE label = 'positive' AND status = 'F' UNION ALL SELECT case_id, dst FROM e WHERE label = 'positive' AND status = 'F') x)
 SELECT e.edge_id, e.case_id, e.label, (e.case_id, e.src) IN (SELECT (case_id, n) FROM black) AS src_is_black, (e.case_id, e.dst) IN (SELECT (case_id, n) FROM black) AS dst_is_black, e.label = 'hard_negative' AS is_hard_negative FROM e""",
)
def export_edge_table(t: Tables) -> DataFrame:
    label = F.when((F.col("edge_type") == 0) & (F.col("priority") == "1-URGENT"), "positive").when(F.col("priority") == "5-LOW", "hard_negative").otherwise("negative")
    labels = t.dense.select("case_id", "edge_id", label.alias("label"), (F.col("status") == "F").alias("counts"))
    return export_table(t.dense, labels).select("edge_id", "case_id", "label", "src_is_black", "dst_is_black", "is_hard_negative")


def export_table(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled edges with flags: whether an end touches a positive edge, and hard negatives."""
    rows = edges.join(labels, ["case_id", "edge_id"], "left")
    black = rows.where("label in ('positive', 'reported_positive') and counts").select("case_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    for end in ("src", "dst"):
        mark = black.select("case_id", F.col("node").alias(end), F.lit(True).alias(f"{end}_is_black"))
        rows = rows.join(mark, ["case_id", end], "left").withColumn(f"{end}_is_black", F.coalesce(f"{end}_is_black", F.lit(False)))
    return rows.withColumn("is_hard_negative", F.col("label") == "hard_negative").withColumn("is_boundary", F.col("label") == "boundary")


@query("verify_manifest", """SELECT o_orderstatus AS part, o_orderstatus = 'F' AS matches, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'changed' ELSE 'missing,unlisted' END AS statuses FROM orders GROUP BY 1""")
def verify_manifest(t: Tables) -> DataFrame:
    """Files held against a manifest of their digests; here one part has changed and one has other names since."""
    path = S.scratch(t.spark, "files")
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").repartition("o_orderstatus").write.option("maxRecordsPerFile", 100_000).partitionBy("o_orderstatus").json(path)
    files = S.file_digests(t.spark, path)
    part = F.regexp_extract("path", "o_orderstatus=([^/]*)", 1)
    at = S.scratch(t.spark, "manifest")
    changed = F.when(part == "O", F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    files.select(F.when(part == "P", F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"), "n_bytes", changed.alias("sha256")).write.json(at)
    manifest = t.spark.read.schema("path string, n_bytes long, sha256 string").json(at)
    return S.verified(files, manifest).groupBy(part.alias("part")).agg(F.bool_and(F.col("status") == "ok").alias("matches"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


@query("restore_local_artifacts", """SELECT o_orderkey AS doc, 'case ' || CAST(o_custkey AS VARCHAR) AS case_dir FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def restore_local_artifacts(t: Tables) -> DataFrame:
    name = F.concat(F.lit("case "), F.col("o_custkey").cast("string"))
    published = t.orders.select(F.when(F.col("o_orderkey") % 5 == 0, F.lit("../x")).otherwise(name).alias("case_dir"), F.col("o_orderkey").alias("doc"))
    existing = t.customer.where("c_acctbal < 0").select(F.concat(F.lit("case "), F.col("c_custkey").cast("string")).alias("case_dir"))
    return S.restorable(published, existing, force=False).select("case_dir", "doc")


@query("upsert_latest", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, 100 AS created_at FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, 200 FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0""")
def upsert_latest(t: Tables) -> DataFrame:
    row = lambda where, price, at: t.orders.where(where).select("o_orderkey", F.expr(price).alias("price"), F.lit(at).alias("created_at"))
    return R.upsert(row("o_orderkey % 2 = 0", "o_totalprice", 100), row("o_orderkey % 3 = 0", "o_totalprice + 1", 200), ["o_orderkey"])


@query("replace_snapshot", """SELECT case_id, count(*) AS purged, count(*) FILTER (edge_type = 0) AS inserted FROM dense GROUP BY case_id""")
def replace_snapshot(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "snapshot")
    rows = t.dense.select("edge_id", "edge_type", "case_id")
    return S.replace_partitions(t.spark, path, rows, rows.where("edge_type = 0"), ["case_id"])


@query("document_hash", """SELECT event_id, sha256('{"event_id": ' || CAST(event_id AS VARCHAR) || ', "event_type": "' || event_type || '"}') AS digest FROM events""")
def document_hash(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event_type": "'), "event_type", F.lit('"}'))
    return t.events.select("event_id", F.sha2(body, 256).alias("digest"))


@query("dual_source_load", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'primary' ELSE 'backup' END AS origin FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0""")
def dual_source_load(t: Tables) -> DataFrame:
    part = lambda n, name: t.orders.where(F.col("o_orderkey") % n == 0).select("o_orderkey", F.lit(name).alias("origin"))
    return R.with_fallback(part(3, "primary"), part(2, "backup"), ["o_orderkey"])


@query("scan_transfer_sheet", """SELECT tx_hash, ts, src AS from_address, dst AS to_address, CAST(amount AS DOUBLE) AS value FROM dense WHERE status = 'P' AND asset <> 'A'""")
def scan_transfer_sheet(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "sheet")
    rows = t.dense.where("status = 'P'").select(F.when(F.col("asset") != "A", F.col("tx_hash")).alias("Txn Hash"), F.col("ts").alias("Block Time"), F.col("src").alias("Sender From"), F.col("dst").alias("To Address"), F.col("amount").alias("Value (USD)"))
    rows.write.option("header", True).csv(path)
    sheet = S.transfer_sheet(t.spark.read.option("header", True).csv(path))
    return sheet.select("tx_hash", F.col("timestamp").cast("long").alias("ts"), "from_address", "to_address", F.col("value").cast("double").alias("value"))


@query("case_list_scan", """SELECT 'case ' || CAST(c_custkey AS VARCHAR) AS name, row_number() OVER (ORDER BY c_custkey) AS pos, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS times FROM customer""")
def case_list_scan(t: Tables) -> DataFrame:
    """An ordered list in several files, with comments, blank lines and names that stand twice."""
    path = S.scratch(t.spark, "list")
    name = F.concat(F.lit("case "), F.col("c_custkey").cast("string"))
    lines = t.customer.select("c_custkey", F.explode(F.array_compact(F.array(F.concat(name, F.lit("  # comment")), F.lit(""), F.when(F.col("c_custkey") % 10 == 0, name)))).alias("value"))
    lines.orderBy("c_custkey").select("value").write.option("maxRecordsPerFile", 100_000).text(path)
    return S.case_list(t.spark, path)


@query("qa_partitions", """SELECT case_id AS case_dir, CASE WHEN verification_status = 'reported' THEN 'general' ELSE 'chain' END AS qa_domain, count(*) AS n FROM ev_edges GROUP BY 1, 2""")
def qa_partitions(t: Tables) -> DataFrame:
    path = S.scratch(t.spark, "qa")
    rows = t.ev_edges.select(F.col("case_id").alias("case_dir"), F.when(F.col("verification_status") == "reported", "general").otherwise("chain").alias("qa_domain"), "reported_id")
    rows.repartition("case_dir", "qa_domain").write.partitionBy("case_dir", "qa_domain").parquet(path)
    return t.spark.read.parquet(path).groupBy("case_dir", "qa_domain").agg(F.count("*").alias("n"))


@query("latest_version_scan", """SELECT o_custkey AS case_key, o_orderkey AS task FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 12 DESC) AS r FROM orders) x WHERE r = 1""")
def latest_version_scan(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("case_key"), F.col("o_orderkey").alias("task"), F.concat(F.lit("flows.v"), (F.col("o_orderkey") % 12).cast("string")).alias("dataset_version"))
    return S.latest_version(rows, ["case_key"], "dataset_version").select("case_key", "task")


@query("run_tables", """SELECT 'run_' || CAST(o_orderkey % 3 AS VARCHAR) AS run_id, count(DISTINCT o_custkey) AS n_tasks, count(DISTINCT o_custkey) AS n_rows FROM orders GROUP BY 1""")
def run_tables(t: Tables) -> DataFrame:
    rows = t.orders.select(F.concat(F.lit("run_"), (F.col("o_orderkey") % 3).cast("string")).alias("run_id"), F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("at"))
    latest = R.keep_first(rows, ["run_id", "task_id"], [F.desc("at")])
    return latest.groupBy("run_id").agg(F.count_distinct("task_id").alias("n_tasks"), F.count("*").alias("n_rows"))


@query(
    "artifact_status",
    """SELECT case_id, max(CASE WHEN stage = 'theft' THEN 1 ELSE 0 END) = 1 AS report, max(CASE WHEN stage = 'layering' THEN 1 ELSE 0 END) = 1 AS summary, max(CASE WHEN confidence = 'A' THEN 1 ELSE 0 END) = 1 AS evidence FROM ev_edges GROUP BY case_id""",
)
def artifact_status(t: Tables) -> DataFrame:
    listed = t.ev_edges.select("case_id", F.explode(F.array_compact(F.array(F.when(F.col("stage") == "theft", "report"), F.when(F.col("stage") == "layering", "summary"), F.when(F.col("confidence") == "A", "evidence")))).alias("artifact"))
    wide = listed.groupBy("case_id").pivot("artifact", ["report", "summary", "evidence"]).count()
    return wide.select("case_id", *((F.coalesce(F.col(c), F.lit(0)) > 0).alias(c) for c in ("report", "summary", "evidence")))
