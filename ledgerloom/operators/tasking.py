"""Decision tasks from labelled candidate pairs, in fixed random orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import stable_hash
from .relational import top_n_per_group


def candidate_sets(pairs: DataFrame, most: int = 12, ratio: int = 3) -> DataFrame:
    """Per source a capped choice of candidates: of follow max(1, min(n, most // max(2, ratio + 1))), raised to 2 where there
    is no ignore; one stop; one inspect; the rest ignore. Sets of one candidate, or with nothing to act on, are dropped.

    ``pairs`` has case_id, src, candidate_id, action. Order within an action is by hash.
    """
    key = F.sha2("candidate_id", 256)
    node = Window.partitionBy("case_id", "src")
    n = lambda a: F.count_if(F.col("action") == a).over(node)
    # Places first: their order by source and action serves the counts by source too.
    rows = pairs.select("case_id", "src", "candidate_id", "action", key.alias("__h")).withColumn("place", F.row_number().over(Window.partitionBy("case_id", "src", "action").orderBy("__h")))
    rows = rows.withColumns({"n_follow": n("follow"), "n_stop": n("stop"), "n_inspect": n("inspect"), "n_ignore": n("ignore")})
    cap = F.greatest(F.lit(1), F.least("n_follow", F.lit(most // max(2, ratio + 1))))
    cap = F.when(F.col("n_ignore") == 0, F.least(F.col("n_follow"), F.greatest(F.lit(2), cap))).otherwise(F.least(F.col("n_follow"), cap))
    rows = rows.withColumn("cap_follow", cap)
    one = lambda c: F.least(F.lit(1), F.col(c))
    room = F.lit(most) - F.col("cap_follow") - one("n_stop") - one("n_inspect")
    limit = F.when(F.col("action") == "follow", F.col("cap_follow")).when(F.col("action").isin("stop", "inspect"), 1).otherwise(room)
    kept = rows.where(F.col("place") <= limit)
    sets = kept.groupBy("case_id", "src").agg(F.array_sort(F.collect_list(F.struct("__h", "candidate_id", "action"))).alias("c"))
    sets = sets.where((F.size("c") >= 2) & F.exists("c", lambda x: x["action"] != "ignore"))
    return sets.select(
        F.concat(F.lit("state:"), stable_hash("case_id", "src")).alias("state_id"),
        "case_id",
        F.col("src").alias("current_node"),
        F.transform("c", lambda x: x["candidate_id"]).alias("candidates"),
        F.transform("c", lambda x: x["action"]).alias("actions"),
    )


def edge_tasks(sets: DataFrame) -> DataFrame:
    """One decision task for each set: public candidates, gold actions, how many to choose, difficulty."""
    n = F.size("candidates")
    follow = F.filter(F.arrays_zip("candidates", "actions"), lambda x: x["actions"] == "follow")
    return sets.select(
        F.concat_ws(":", "state_id", F.lit("eac")).alias("task_id"),
        "case_id",
        "current_node",
        "candidates",
        F.transform(follow, lambda x: x["candidates"]).alias("gold"),
        F.least(F.lit(3), n).alias("top_k"),
        F.when(n <= 3, "easy").when(n <= 8, "medium").otherwise("hard").alias("difficulty"),
    )


def noise_decoys(pairs: DataFrame, per_group: int = 10, per_case: int = 24) -> DataFrame:
    """Groups of ignore-only candidates of one source, three and more, the first ten by hash; so many groups a case."""
    bad = pairs.groupBy("case_id", "src").agg(F.count_if(F.col("action") != "ignore").alias("n_act"), F.count("*").alias("n")).where("n_act = 0 and n >= 3").select("case_id", "src")
    some = top_n_per_group(bad, ["case_id"], [F.sha2(F.concat_ws("|", "case_id", "src"), 256)], per_case)
    rows = pairs.join(some, ["case_id", "src"])
    first = top_n_per_group(rows, ["case_id", "src"], [F.sha2("candidate_id", 256)], per_group)
    return first.groupBy("case_id", "src").agg(F.array_sort(F.collect_list("candidate_id")).alias("decoys"))


def seeded_tasks(sets: DataFrame, n: int = 4) -> DataFrame:
    """First n states of a case by hash, and those of them with something to follow as gold seeds."""
    first = top_n_per_group(sets, ["case_id"], [F.sha2("state_id", 256)], n)
    gold = F.when(F.array_contains("actions", "follow"), F.col("current_node"))
    return first.groupBy("case_id").agg(F.array_sort(F.collect_list("state_id")).alias("states"), F.array_sort(F.collect_list(gold)).alias("gold_seeds"))


def existence_tasks(edges: DataFrame, n_positive: int = 8, n_negative: int = 4) -> DataFrame:
    """Tasks whether (src, dst, edge_type) occurs: pairs that do, and three kinds of pairs that do not: another type, reversed, another receiver of the case.

    Each negative is checked against all edges by an anti-join.
    """
    facts = edges.select("case_id", "src", "dst", "edge_type").distinct()
    by = lambda df, n: top_n_per_group(df.withColumn("__h", F.sha2(F.concat_ws("|", "case_id", "src", "dst", "edge_type"), 256)), ["case_id"], [F.col("__h")], n).drop("__h")
    base = by(facts, n_positive)
    absent = lambda df: df.join(facts, ["case_id", "src", "dst", "edge_type"], "left_anti").distinct()
    other_type = absent(base.withColumn("edge_type", 1 - F.col("edge_type")))
    reverse = absent(base.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))
    ends = base.select("case_id", F.col("dst").alias("to")).distinct()
    same_case = absent(base.join(ends, "case_id").where("to != dst and to != src").select("case_id", "src", F.col("to").alias("dst"), "edge_type"))
    out = base.withColumn("kind", F.lit("positive"))
    for kind, df in (("wrong_type", other_type), ("reversed", reverse), ("same_case", same_case)):
        out = out.unionByName(by(df, n_negative).withColumn("kind", F.lit(kind)))
    return out.withColumn("task_id", F.concat(F.lit("dte:"), stable_hash("case_id", "src", "dst", F.col("edge_type").cast("string"), "kind")))
