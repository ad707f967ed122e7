"""Scores of stored predictions and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("follow", "inspect", "stop", "ignore")


def macro_f1(rows: DataFrame, keys: Sequence[str], predicted: str, gold: str, weight: str | None = None) -> DataFrame:
    """Mean F1 of the classes that occur: 2 tp / (2 tp + fp + fn). A row counts once, or as often as ``weight`` says."""
    hit, n = F.col(predicted) == F.col(gold), F.lit(1) if weight is None else F.col(weight)
    long = rows.select(*keys, F.explode(F.array(F.struct(F.col(predicted).alias("c"), F.when(hit, n).otherwise(0).alias("tp"), F.when(hit, 0).otherwise(n).alias("err")), F.struct(F.col(gold).alias("c"), (n * 0).alias("tp"), F.when(hit, 0).otherwise(n).alias("err")))).alias("x"))
    per = long.where("x.c is not null").groupBy(*keys, "x.c").agg(F.sum("x.tp").alias("tp"), F.sum("x.err").alias("err"))
    return per.groupBy(*keys).agg(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("err"))).alias("macro_f1"))


def brier(gold: str, prefix: str = "p_") -> Column:
    """Sum over actions of (p - 1[gold])^2; a missing gold is an all-zero target."""
    parts = [F.pow(F.col(f"{prefix}{a}") - F.coalesce((F.col(gold) == a).cast("int"), F.lit(0)), 2) for a in ACTIONS]
    return parts[0] + parts[1] + parts[2] + parts[3]


def ece(rows: DataFrame, keys: Sequence[str], p: str, hit: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins; the last one is closed."""
    edges = F.array(*(F.lit(i / bins) for i in range(bins)))
    place = F.size(F.filter(edges, lambda e: e <= F.col(p)))
    per = rows.withColumn("__bin", place).groupBy(*keys, "__bin").agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(hit).cast("double")).alias("acc"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def precision_recall(n_both: Column, n_found: Column, n_gold: Column, empty: float) -> tuple[Column, Column]:
    """Two conventions for empty sets: ``empty`` is what 0 / 0 gives."""
    both_empty = (n_found == 0) & (n_gold == 0)
    one = lambda n: F.when(both_empty, empty).otherwise(F.coalesce(F.try_divide(n_both.cast("double"), n), F.lit(0.0)))
    return one(n_found), one(n_gold)


def json_answer(c: Column | str, schema: str) -> Column:
    """The JSON object of an answer: fences are stripped; text before the first and after the last brace is dropped."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(c, "```(?:json)?", "")
    body = F.regexp_extract(bare, "(?s)([{].*[}])", 1)
    return F.from_json(F.when(body != "", body), schema)


def edge_answer_errors(answers: DataFrame, candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Errors of stored edge decisions by task: missing, unknown and repeated candidates, bad actions and probabilities.

    ``answers``: task_id, edge_id, action, p_follow..p_ignore. ``candidates``: task_id, edge_id.
    """
    ps = [F.col(f"p_{a}") for a in ACTIONS]
    total = ps[0] + ps[1] + ps[2] + ps[3]
    once = answers.groupBy("task_id", "edge_id").agg(F.count("*").alias("times"), F.first("action").alias("action"), F.first(total).alias("total"), F.min(F.least(*ps)).alias("low"), F.max(F.greatest(*ps)).alias("high"))
    both = candidates.withColumn("asked", F.lit(True)).join(once.withColumn("given", F.lit(True)), ["task_id", "edge_id"], "full_outer")
    err = lambda c, name: F.when(c, F.lit(name))
    each = F.array_compact(
        F.array(
            err(F.col("given").isNull(), "missing"),
            err(F.col("asked").isNull(), "unknown"),
            err(F.col("times") > 1, "repeated"),
            err(~F.col("action").isin(*ACTIONS), "action"),
            err((F.col("low") < 0) | (F.col("high") > 1) | (F.abs(F.col("total") - 1) > 0.02), "probability"),
        )
    )
    rows = both.withColumn("e", F.explode_outer(each))
    return rows.groupBy("task_id").agg(F.array_sort(F.collect_set("e")).alias("errors"), F.count("e").alias("n_errors"))


def protocol_cover(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """By task: groups, groups that a call covers, repeated calls and calls outside the groups."""
    once = calls.groupBy("task_id", "edge_id").agg(F.count("*").alias("times"))
    met = once.join(groups, ["task_id", "edge_id"], "left")
    used = met.groupBy("task_id").agg(F.count_distinct("group_id").alias("covered"), F.sum(F.col("times") - 1).alias("repeated"), F.count_if(F.col("group_id").isNull()).alias("outside"))
    return groups.groupBy("task_id").agg(F.count_distinct("group_id").alias("groups")).join(used, "task_id", "left").na.fill(0)
