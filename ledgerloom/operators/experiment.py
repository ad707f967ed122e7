"""A comparison run over a table of tasks: load, find seeds, classify, roll out and score, for all tasks at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs, policies
from .detectors import detect
from .relational import dropped, kept, top_n_per_group
from .scoring import brier, macro_f1

STAGES = ("task_loaded", "node_detection", "edge_classification", "rollout", "scoring")
#: Seeds of these tasks are found; others give their start.
SEEDLESS = "subgraph_noise_filtering"


def leaked_cases(tasks: DataFrame, training_cases: DataFrame) -> DataFrame:
    """Cases that are both asked about and trained on; a run must have none."""
    return tasks.select("case_id").distinct().join(training_cases.select("case_id"), "case_id", "left_semi")


def run(tasks: DataFrame, candidates: DataFrame, gold: DataFrame | None, method: str, top_k: int = 3, seed_threshold: float = 0.9, depth: int = 3, beam: int = 3) -> tuple[DataFrame, DataFrame]:
    """Results and stages of a run.

    ``tasks``: task_id, task_type, start_node, seeds (the nodes that may be one; null: all sources). ``candidates``: task_id
    and the columns that detectors ask for. ``gold``: task_id, edge_id, gold; None where candidates
    bring it as a column, which spares a join of all edges. Candidates are read by each stage and not copied. A task without candidates or without a
    start fails with its reason and the others go on. Results: task_id, task_type, status, error, seeds, n_paths,
    accuracy, macro_f1, brier. Stages: task_id, stage, n (rows that it made), for tasks that ran.
    """
    edges = candidates.withColumnRenamed("task_id", "case_id")
    asked = tasks.select(F.col("task_id").alias("case_id"), "task_type", "start_node", "seeds")
    loaded = edges.groupBy("case_id").agg(F.count("*").alias("n"))
    seedless = asked.where(F.col("task_type") == SEEDLESS).select("case_id", "seeds")
    scores = policies.max_outflow_scores(edges.join(seedless, "case_id", "left_semi")).join(seedless, "case_id")
    allowed = F.col("seeds").isNull() | F.array_contains("seeds", F.col("src"))
    found = top_n_per_group(scores.where(allowed & (F.col("probability") >= seed_threshold)), ["case_id"], [F.desc("probability"), F.col("src")], top_k)
    given = asked.where((F.col("task_type") != SEEDLESS) & F.col("start_node").isNotNull()).select("case_id", F.col("start_node").alias("node"))
    seeds = kept(found.select("case_id", F.col("src").alias("node")).unionByName(given))
    predicted = detect(method, edges, seeds)
    paths = kept(graphs.beam_rollout(predicted, seeds, depth=depth, beam=beam))
    scored = predicted.where("gold is not null") if gold is None else predicted.join(gold.withColumnRenamed("task_id", "case_id"), ["case_id", "edge_id"])
    # A row by case, gold and action has all that the metrics ask for.
    by_action = kept(scored.groupBy("case_id", "gold", "action").agg(F.count("*").alias("n"), F.sum(brier("gold")).alias("brier")))
    hits = F.sum(F.when(F.col("gold").isNull() | F.col("action").isNull(), None).when(F.col("action") == F.col("gold"), F.col("n")).otherwise(0))
    metrics = by_action.groupBy("case_id").agg((hits / F.sum(F.when(F.col("gold").isNotNull() & F.col("action").isNotNull(), F.col("n")))).alias("accuracy"), (F.sum("brier") / F.sum("n")).alias("brier"))
    metrics = metrics.join(macro_f1(by_action, ["case_id"], "action", "gold", "n"), "case_id", "left")
    started = seeds.groupBy("case_id").agg(F.array_sort(F.collect_set("node")).alias("found"))
    ended = paths.groupBy("case_id").agg(F.count("*").alias("n_paths"))
    rows = asked.drop("seeds").join(loaded, "case_id", "left").join(started, "case_id", "left").join(ended, "case_id", "left").join(metrics, "case_id", "left")
    error = F.when(F.col("n").isNull(), "no candidates").when((F.col("task_type") != SEEDLESS) & F.col("start_node").isNull(), "no start node")
    ran = F.col("error").isNull()
    none = F.array().cast("array<string>")
    results = rows.withColumn("error", error).select(
        F.col("case_id").alias("task_id"),
        "task_type",
        F.when(ran, "completed").otherwise("failed").alias("status"),
        "error",
        F.when(ran, F.coalesce("found", none)).otherwise(none).alias("seeds"),
        F.when(ran, F.coalesce("n_paths", F.lit(0))).otherwise(0).alias("n_paths"),
        *(F.when(ran, F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "brier")),
    )
    results = kept(results)
    made = zip(STAGES, (loaded, *(df.groupBy("case_id").agg(F.count("*").alias("n")) for df in (seeds, predicted, paths)), by_action.groupBy("case_id").agg(F.sum("n").alias("n"))))
    counts = reduce(DataFrame.unionByName, (df.withColumn("stage", F.lit(s)) for s, df in made))
    alive = results.where("status = 'completed'").select("task_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    stages = alive.join(counts.withColumnRenamed("case_id", "task_id"), ["task_id", "stage"], "left").na.fill(0, ["n"])
    stages = kept(stages.select("task_id", "stage", "n"))
    dropped(seeds, paths, by_action)
    return results, stages
