"""Edge policies: which outgoing transfers of active nodes carry the traced funds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DEC = "decimal(18,4)"


def bucket() -> Column:
    """The unit in which a budget is kept: token, else asset, else kind of edge."""
    return F.coalesce("token_address", "asset", F.col("edge_type").cast("string"))


def max_outflow_sources(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Sources by case with mx, total, n and rank, by their largest single transfer, then total, then count."""
    stats = edges.groupBy("case_id", "src").agg(F.max("amount").alias("mx"), F.sum("amount").alias("total"), F.count("*").alias("n"))
    order = Window.partitionBy("case_id").orderBy(F.desc("mx"), F.desc("total"), F.desc("n"), "src")
    ranked = stats.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def max_outflow_scores(edges: DataFrame) -> DataFrame:
    """``max_outflow_sources`` with a probability: the largest transfer's share of the case's largest, or the count's where all amounts are 0."""
    ranked = max_outflow_sources(edges)
    per_case = Window.partitionBy("case_id")
    top, most = F.max("mx").over(per_case), F.max("n").over(per_case)
    p = F.when(top > 0, F.col("mx").cast("double") / top.cast("double")).otherwise(F.col("n") / most)
    return ranked.withColumn("probability", p)


def mark_active(edges: DataFrame, active: DataFrame) -> DataFrame:
    """``edges`` with active: whether their source is an active node of the case."""
    nodes = active.select("case_id", F.col("node").alias("src"), F.lit(True).alias("active")).distinct()
    return edges.join(nodes, ["case_id", "src"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


def taint(edges: DataFrame, active: DataFrame, order: str = "fifo", ratio: float = 0.5) -> DataFrame:
    """Allots a budget of ``ratio`` of each active node's outflow, by unit, to its transfers in order.

    Orders: fifo (time, block, id; unknown times last), lifo (the whole key reversed), tiho (largest first).
    A running sum replaces the sequential loop: what a transfer gets is what the ones before it left, at most
    its own amount. Amounts of 0 and less weigh 1. Adds active, weight, allocated and score (allocated / weight).
    """
    late = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(2**62))
    keys = {
        "fifo": [late("ts"), late("block_number"), F.col("edge_id")],
        "lifo": [late("ts").desc(), late("block_number").desc(), F.col("edge_id").desc()],
        "tiho": [F.col("weight").desc(), F.col("edge_id")],
    }[order]
    # Only edges of active nodes have a budget; the others go on without a window.
    rows = mark_active(edges, active).withColumn("weight", F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(1).cast(_DEC))).withColumn("bucket", bucket())
    unit = Window.partitionBy("case_id", "src", "bucket")
    before = unit.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    hot = rows.where("active")
    budget = F.sum("weight").over(unit) * F.lit(str(ratio)).cast("decimal(6,4)")
    hot = hot.withColumn("budget", budget).withColumn("spent", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    zero = F.lit(0).cast("decimal(38,8)")
    hot = hot.withColumn("allocated", F.greatest(zero, F.least(F.col("weight").cast("decimal(38,8)"), (F.col("budget") - F.col("spent")).cast("decimal(38,8)"))))
    hot = hot.withColumn("score", F.col("allocated").cast("double") / F.col("weight").cast("double")).drop("budget", "spent", "bucket")
    cold = rows.where("not active").drop("bucket").withColumn("allocated", zero).withColumn("score", F.lit(0.0))
    return hot.unionByName(cold)


def constant(edges: DataFrame, active: DataFrame, p: float) -> DataFrame:
    """A fixed score on outgoing transfers of active nodes, 0 on others."""
    return mark_active(edges, active).withColumn("score", F.when(F.col("active"), F.lit(p)).otherwise(F.lit(0.0)))


def binary_actions(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probabilities of the four actions from a score; follow from the threshold on, else ignore."""
    s = F.col("score")
    return scored.withColumns({"p_follow": s, "p_inspect": F.lit(0.0), "p_stop": F.lit(0.0), "p_ignore": 1 - s, "action": F.when(s >= threshold, "follow").otherwise("ignore")})


def poison_actions(scored: DataFrame) -> DataFrame:
    """Probabilities where what a score leaves is shared by the other three actions; the first of the largest is the action."""
    s, rest = F.col("score"), (1 - F.col("score")) / 3
    out = scored.withColumns({"p_follow": F.when(F.col("active"), s).otherwise(0.0), "p_inspect": F.when(F.col("active"), rest).otherwise(0.0), "p_stop": F.when(F.col("active"), rest).otherwise(0.0), "p_ignore": F.when(F.col("active"), rest).otherwise(1.0)})
    return out.withColumn("action", argmax_action())


def argmax_action() -> Column:
    """The action with the largest probability; ties go to the first of follow, inspect, stop, ignore."""
    top = F.greatest("p_follow", "p_inspect", "p_stop", "p_ignore")
    return F.when(F.col("p_follow") == top, "follow").when(F.col("p_inspect") == top, "inspect").when(F.col("p_stop") == top, "stop").otherwise("ignore")
