"""Labels and actions of transfers from reported evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence as E

#: Roles at which tracing stops, and roles that need a closer look.
STOP_ROLES = ("exchange_deposit", "mixer")
INSPECT_ROLES = ("router", "bridge")


def label_edges(edges: DataFrame, tx_pairs: DataFrame, reported_pairs: DataFrame, seeds: DataFrame, attribution: DataFrame) -> DataFrame:
    """case_id, edge_id, label, action, confidence for all edges.

    Positive: a pair of evidence transactions, or a reported pair in either direction. Else hard_negative where an end
    is a seed, else negative. ``tx_pairs`` and ``reported_pairs`` have case_id, src, dst; a reported pair also
    reported_id.
    """
    rows = E.pair_or_reverse(edges, reported_pairs, "reported_id")
    rows = rows.join(tx_pairs.select("case_id", "src", "dst", F.lit(True).alias("by_tx")).distinct(), ["case_id", "src", "dst"], "left")
    rows = E.touches(rows, seeds)
    positive = F.col("by_tx").isNotNull() | F.col("reported_id").isNotNull()
    rows = rows.withColumn("label", F.when(positive, "positive").when(F.col("touches_seed"), "hard_negative").otherwise("negative"))
    who = attribution.select("case_id", F.col("address").alias("dst"), "role", "n_entities")
    rows = rows.join(who, ["case_id", "dst"], "left").withColumn("action", action())
    return rows.select("case_id", "edge_id", "label", "action", F.when(positive, "B").otherwise("C").alias("confidence"), "reported_id")


def pair_actions(edges: DataFrame, tx_pairs: DataFrame, reported_pairs: DataFrame, attribution: DataFrame) -> DataFrame:
    """case_id, src, dst, action: one row a pair of nodes that an edge links, with the action that ``label_edges`` gives all its edges.

    Labels depend on the pair alone, and only positive ones on the receiver. So the few pairs that evidence speaks of, in
    both directions where they are reported, get their action first; then edges and these meet in one shuffle by source.
    """
    keys = ["case_id", "src", "dst"]
    back = reported_pairs.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    positive = tx_pairs.select(*keys).unionByName(reported_pairs.select(*keys)).unionByName(back).distinct().withColumn("label", F.lit("positive"))
    who = attribution.select("case_id", F.col("address").alias("dst"), "role", "n_entities")
    told = positive.join(who, ["case_id", "dst"], "left").select(*keys, action().alias("action"))
    there = edges.select(*keys, F.lit(None).cast("string").alias("action"), F.lit(True).alias("there"))
    rows = there.unionByName(told.withColumn("there", F.lit(False))).where("case_id is not null and src is not null and dst is not null").repartition("case_id", "src")
    pairs = rows.groupBy(*keys).agg(F.max("action").alias("action"), F.max("there").alias("there")).where("there")
    return pairs.select(*keys, F.coalesce("action", F.lit("ignore")).alias("action"))


def action() -> Column:
    """What to do with a labelled edge: negatives are ignored; else the receiver's role decides."""
    return (
        F.when(F.col("label") != "positive", "ignore")
        .when(F.col("n_entities") > 1, "inspect")
        .when(F.col("role").isin(*STOP_ROLES), "stop")
        .when(F.col("role").isin(*INSPECT_ROLES), "inspect")
        .otherwise("follow")
    )


def reported_labels(reported: DataFrame) -> DataFrame:
    """A label for each reported edge that the chain does not confirm; not for evaluation."""
    rows = reported.where("verification_status != 'chain_verified'")
    return rows.select("case_id", F.concat(F.lit("reported:"), "reported_id").alias("edge_id"), F.lit("reported_positive").alias("label"), F.lit("inspect").alias("action"), "confidence", "reported_id")


def tx_rules(edges: DataFrame, attackers: DataFrame, small: float, large: float) -> DataFrame:
    """All labels of ordered rules and the first of them: small and large native outflows, token outflow, inbound funding."""
    rows = edges
    for end in ("src", "dst"):
        mark = attackers.select("case_id", F.col("node").alias(end), F.lit(True).alias(f"{end}_bad")).distinct()
        rows = rows.join(mark, ["case_id", end], "left")
    out, native = F.col("src_bad").isNotNull(), F.col("token_address").isNull()
    rule = lambda c, name: F.when(c, F.lit(name))
    labels = F.array_compact(
        F.array(
            rule(out & native & (F.col("amount") > 0) & (F.col("amount") <= small), "attacker_small_outflow"),
            rule(out & native & (F.col("amount") >= large), "attacker_large_outflow"),
            rule(out & ~native, "attacker_token_outflow"),
            rule(F.col("dst_bad").isNotNull(), "attacker_inbound_funding"),
        )
    )
    return rows.withColumn("labels", labels).withColumn("primary_label", F.coalesce(F.try_element_at("labels", F.lit(1)), F.lit("unclassified")))


def recommended_action(role: str, stage: str, verified: str) -> Column:
    """Boundary rules of a reported edge, the first that holds."""
    r = F.col(role)
    return (
        F.when(r == "mixer", "stop_at_mixer")
        .when(r == "exchange_deposit", "request_exchange_records")
        .when(r.isin(*INSPECT_ROLES), "decode_contract_call")
        .when(~F.col(verified), "verify_on_chain")
        .when(F.col(stage) == "cash_out", "check_destination")
        .otherwise("continue_tracing")
    )
