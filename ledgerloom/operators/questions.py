"""Question rows from evidence tables. All have the same columns, so that they unite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import padded
from .relational import keep_first, top_n_per_group
from .relational import numbered as number_rows

COLUMNS = ("case_id", "question_type", "subject", "predicate", "object")


def rows(df: DataFrame, kind: str, subject: Column | str, predicate: Column | str, obj: Column | str) -> DataFrame:
    """One question a row; rows without an object are dropped."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    predicate = F.lit(predicate) if isinstance(predicate, str) else predicate
    out = df.select("case_id", F.lit(kind).alias("question_type"), col(subject).alias("subject"), predicate.alias("predicate"), col(obj).cast("string").alias("object"))
    return out.where("object is not null and object != ''")


def unpivoted(df: DataFrame, kind: str, subject: str, columns: Sequence[str]) -> DataFrame:
    """One question for each of several columns."""
    long = df.select("case_id", F.col(subject).alias("subject"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(["case_id", "subject"], list(columns), "predicate", "object")
    return rows(long, kind, "subject", F.col("predicate"), "object")


def case_questions(edges: DataFrame) -> DataFrame:
    facts = edges.groupBy("case_id").agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("stage")), ", ").alias("stages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return unpivoted(facts, "case", "case_id", ["n_edges", "stages", "first_ts", "last_ts"])


def entity_questions(entities: DataFrame, n: int = 80) -> DataFrame:
    """Role, chain, address and confidence of the first n entities by role and key."""
    return unpivoted(top_n_per_group(entities, ["case_id"], [F.col("role"), F.col("entity_id")], n), "entity", "entity_id", ["role", "chain", "address", "confidence"])


def edge_questions(edges: DataFrame) -> DataFrame:
    facts = unpivoted(edges, "edge", "reported_id", ["src", "dst", "asset", "stage", "pattern"])
    true = rows(edges.withColumn("yes", F.lit("true")), "edge_verification", "reported_id", F.concat(F.lit("is "), "stage"), "yes")
    unsure = rows(edges.where("verification_status != 'chain_verified'").withColumn("no", F.lit("false")), "edge_verification", "reported_id", "chain verified", "no")
    return facts.unionByName(true).unionByName(unsure)


def negative_questions(edges: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """False statements: the first of the values that differs from the true one."""
    other = F.try_element_at(F.filter(F.array(*(F.lit(v) for v in values)), lambda v: v != F.col(column)), F.lit(1))
    return rows(edges.withColumn("other", other), "negative", "reported_id", f"not {column}", "other")


def direct_link_questions(edges: DataFrame) -> DataFrame:
    """Whether two nodes are linked: all pairs that are, and for each source the first node of the case that it has no edge to."""
    pairs = edges.select("case_id", "src", "dst").distinct()
    yes = rows(pairs.withColumn("yes", F.lit("true")), "direct_link", "src", F.concat(F.lit("linked to "), "dst"), "yes")
    # The first node without a link is among the first 1 + degree nodes by name, so only those are met.
    nodes = pairs.select("case_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    placed = number_rows(nodes, ["case_id"], ["node"], "place")
    asked = pairs.groupBy("case_id", "src").agg(F.count("*").alias("degree"))
    reach = asked.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int") + 2)))
    free = reach.join(placed, ["case_id", "place"]).where("node != src").join(pairs.withColumnRenamed("dst", "node"), ["case_id", "src", "node"], "left_anti")
    first = free.groupBy("case_id", "src").agg(F.min("node").alias("node"))
    no = rows(first.withColumn("no", F.lit("false")), "direct_link", "src", F.concat(F.lit("linked to "), "node"), "no")
    return yes.unionByName(no)


def single_hop_questions(edges: DataFrame, by: str, cap: int = 4) -> DataFrame:
    """Receivers of a source by stage or pattern; so many questions a source, the first by value."""
    sets = edges.groupBy("case_id", "src", by).agg(F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("answer"))
    return rows(top_n_per_group(sets, ["case_id", "src"], [F.col(by)], cap), f"single_hop_{by}", "src", F.col(by), "answer")


def numbered(questions: DataFrame) -> DataFrame:
    """Questions without repeats, with ids that count within a case."""
    once = keep_first(questions, list(COLUMNS), [F.lit(0)])
    counted = number_rows(once, ["case_id"], ["question_type", "subject", "predicate", "object"])
    return counted.withColumn("qa_id", F.concat_ws(":", "case_id", padded("n", 5), "question_type")).drop("n")
