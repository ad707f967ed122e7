"""Scans and sinks of files, and tables replaced by key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import version_parts


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and lines that are no object of the schema with their file. Blank lines are skipped."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    names = [c for c in rows.columns if c != "_corrupt"]
    bad = spark.read.text(path).where(F.trim("value") != "").where(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()).select("value", F.col("_metadata.file_path").alias("path"))
    return rows.where("_corrupt is null").select(*names), bad


def write_jsonl(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """JSON lines with keys in alphabetical order."""
    rows.select(*sorted(rows.columns)).write.partitionBy(*partition_by).json(path)


def complete_cases(rows: DataFrame, artifacts: Sequence[str]) -> DataFrame:
    """One row a case from its documents, and whether all artifacts are there."""
    out = rows.groupBy("case_dir").agg(F.max("n_stages").alias("n_stages"), F.collect_set("artifact").alias("have"))
    return out.select("case_dir", "n_stages", (F.size(F.array_except(F.array(*map(F.lit, artifacts)), "have")) == 0).alias("complete"))


def document_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below a folder by name, but for folders that start with _ or xx-: path, n_bytes, modified, and namespace, case
    folder and name by the layout (<namespace>/<case>/<file>, also as key=value folders). Only metadata are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return discovered(files.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified")))


def discovered(files: DataFrame, pattern: str = ".") -> DataFrame:
    """Files (path and more) by name, but for folders that start with _ or xx-, with namespace, case folder and name."""
    parts = F.split("path", "/")
    folder = lambda i: F.regexp_replace(F.element_at(parts, i), "^[^=]*=", "")
    rows = files.where(F.col("path").rlike(pattern) & ~F.col("path").rlike("/(?:[^/=]*=)?(?:_|xx-)[^/]*/"))
    return rows.select(*files.columns, folder(-3).alias("namespace"), folder(-2).alias("case_dir"), F.element_at(parts, -1).alias("name"))


# Documents of a case by the folder and the name of their file; any other run is a collection run.
DOCUMENTS = {("cases", "case.json"): "case_report_manifest", ("summarized", "summary.json"): "case_report_summary", ("summarized", "chain_evidence.json"): "chain_evidence"}
RUN = "report_collection_run"


def case_documents(files: DataFrame, include_runs: bool = False) -> DataFrame:
    """Documents of cases among files (path below the root, content): path, namespace, document_type, case_dir, case_id, case_name.

    A document lies at cases/<case>/case.json or summarized/<case>/summary.json or chain_evidence.json, with ``include_runs``
    also at cases/<case>/run*.json; folders that start with _ or xx- are left out. Id and name come from the content; they
    are null where it is no JSON object or has none.
    """
    parts = F.split("path", "/")
    rows = files.where((F.size(parts) == 3) & ~parts[1].rlike("^(?:_|xx-)")).select("path", "content", parts[0].alias("__base"), parts[1].alias("case_dir"), parts[2].alias("__name"))
    kind = F.lit(None).cast("string")
    for (base, name), value in DOCUMENTS.items():
        kind = F.when((F.col("__base") == base) & (F.col("__name") == name), value).otherwise(kind)
    if include_runs:
        kind = F.when((F.col("__base") == "cases") & F.col("__name").rlike(r"^run.*[.]json$"), RUN).otherwise(kind)
    said = lambda key: F.nullif(F.get_json_object("content", f"$.{key}"), F.lit(""))
    namespace = F.concat_ws(".", "__base", F.regexp_replace("__name", "[.][^.]*$", ""))
    return rows.withColumn("document_type", kind).where("document_type IS NOT NULL").select("path", namespace.alias("namespace"), "document_type", "case_dir", said("case_id").alias("case_id"), said("case_name").alias("case_name"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes and SHA-256 of the files below a folder. A file is read by one task; writers bound its rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and status of files held against a manifest: ok, changed, missing (no file) or unlisted."""
    both = files.alias("f").join(manifest.alias("m"), "path", "full_outer")
    same = (F.col("f.n_bytes") == F.col("m.n_bytes")) & (F.col("f.sha256") == F.col("m.sha256"))
    status = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("m.sha256").isNull(), "unlisted").when(same, "ok").otherwise("changed")
    return both.select("path", status.alias("status"))


def restorable(published: DataFrame, existing: DataFrame, force: bool) -> DataFrame:
    """Published documents with safe folder names; those that exist already only if forced."""
    safe = published.where(F.col("case_dir").rlike("^[A-Za-z0-9][A-Za-z0-9 ._-]*$") & ~F.contains("case_dir", F.lit("..")))
    return safe if force else safe.join(existing.distinct(), "case_dir", "left_anti")


def replace_partitions(spark: SparkSession, path: str, old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Writes ``old``, then replaces the partitions that ``new`` holds; returns purged and inserted rows by key."""
    old.repartition(*keys).write.partitionBy(*keys).parquet(path)
    purged = spark.read.parquet(path).groupBy(*keys).agg(F.count("*").alias("purged"))
    counts = purged.join(new.groupBy(*keys).agg(F.count("*").alias("inserted")), list(keys))
    # The counts are written, as what they were read from is about to be replaced.
    at = scratch(spark, "counts")
    counts.write.parquet(at)
    out = spark.read.schema(counts.schema).parquet(at)
    new.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return out


#: Words of a sheet's header and the column they stand for; the first that fits counts.
_SHEET = (("hash", "tx_hash"), ("time", "timestamp"), ("from", "from_address"), ("to", "to_address"), ("value", "value"), ("amount", "value"))


def transfer_sheet(sheet: DataFrame) -> DataFrame:
    """A sheet with its columns found by words in their names; rows without hash, sender or receiver are dropped."""
    named: dict[str, str] = {}
    for c in sheet.columns:
        for word, name in _SHEET:
            if word in c.lower() and name not in named:
                named[name] = c
                break
    rows = sheet.select(*(F.col(f"`{c}`").alias(n) for n, c in named.items()))
    return rows.na.drop(subset=[c for c in ("tx_hash", "from_address", "to_address") if c in rows.columns])


def case_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of an ordered list, in one file or several in the order of their names, without comments and blanks: name, pos,
    times (more than 1 is an error)."""
    from ..operators.relational import numbered

    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    names = lines.select("file", "at", F.trim(F.regexp_replace("line", "#.*$", "")).alias("name")).where("name != ''")
    first = names.groupBy("name").agg(F.min(F.struct("file", "at")).alias("first"), F.count("*").cast("int").alias("times"))
    rows = first.select("name", "times", "first.*", F.lit(0).alias("all"))
    return numbered(rows, ["all"], ["file", "at"], "pos").select("name", F.col("pos").cast("long").alias("pos"), "times")


def latest_version(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of the numerically latest version by key: one shuffle, in which a version is read once a row."""
    order = Window.partitionBy(*keys).orderBy(F.desc("__parts"))
    ranked = rows.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))).withColumn("__parts", version_parts(version)).withColumn("__rank", F.rank().over(order))
    return ranked.where("__rank = 1").drop("__parts", "__rank")
