"""Communities by rank, suspicious sets of nodes, and ranks by pushes in the order of residuals.

Like the operators in ``graphs``, all work on all cases at once; each round is a table in the shared folder, which goes as
soon as the next one is there.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import DAY, burst_rating
from .relational import dropped, kept, numbered, running_sums, with_summary

RATING_BINS = 10


def rank_community(edges: DataFrame, ranks: DataFrame, sources: DataFrame, phi: float = 1e-3, budget: int = 64) -> DataFrame:
    """Nodes of a case in the order in which its community takes them in, and whether they are in it: case_id, node, rank,
    place, conductance, inside.

    The sources (case_id, node) come first, then nodes by falling rank, the greater name first among equals. The community
    is the first prefix, from the sources on, whose conductance is below ``phi``; else all nodes, but at most ``budget``
    beside the sources. Conductance is the rank of the nodes that edges lead to from the prefix over the rank within it.

    A node joins the boundary at the least place of those that lead to it and leaves it at its own place: two signed events a
    node, whose running sums are the boundaries of all prefixes. Nodes without a rank count as none and are never taken in.
    """
    first = sources.select("case_id", "node").distinct().withColumn("__source", F.lit(True))
    known = ranks.select("case_id", "node", F.greatest(F.col("rank").cast("double"), F.lit(0.0)).alias("rank"))
    rows = known.join(first, ["case_id", "node"], "left").withColumns({"__later": F.col("__source").isNull(), "__falling": -F.col("rank")})
    placed = kept(numbered(rows, ["case_id"], ["__later", "__falling", F.desc("node")], "place").select("case_id", "node", "rank", "place", "__later"))
    pairs = edges.where("src != dst").select("case_id", "src", "dst").distinct()
    entered = pairs.join(placed.select("case_id", F.col("node").alias("src"), "place"), ["case_id", "src"]).groupBy("case_id", F.col("dst").alias("node")).agg(F.min("place").alias("__enter"))
    on_edge = placed.join(entered, ["case_id", "node"]).where("__enter < place")
    come = on_edge.select("case_id", F.col("__enter").alias("place"), F.col("rank").alias("boundary"))
    go = on_edge.select("case_id", "place", (-F.col("rank")).alias("boundary"))
    events = come.unionByName(go).groupBy("case_id", "place").agg(F.sum("boundary").alias("boundary"))
    sums = placed.join(events, ["case_id", "place"], "left").withColumns({"boundary": F.coalesce("boundary", F.lit(0.0)), "within": F.col("rank")})
    sums = running_sums(sums, ["case_id"], "place", ["boundary", "within"])
    # What is left of a boundary that all have left is an error of rounding.
    outside = F.when(F.col("boundary") > 1e-12, F.col("boundary")).otherwise(0.0)
    sums = sums.withColumn("conductance", F.when(F.col("within") > 0, outside / F.col("within")).otherwise(F.lit(float("inf"))))
    n = F.sum((~F.col("__later")).cast("long"))
    sums = with_summary(sums, ["case_id"], __n=n, __all=F.count("*"))
    fits = (F.col("place") >= F.col("__n")) & (F.col("place") <= F.col("__n") + budget)
    sums = with_summary(sums, ["case_id"], __under=F.min(F.when(fits & (F.col("conductance") < phi), F.col("place"))))
    last = F.coalesce("__under", F.least(F.col("__n") + budget, F.col("__all")))
    return sums.select("case_id", "node", "rank", "place", "conductance", (F.col("place") <= last).alias("inside"))


def community_actions(edges: DataFrame, community: DataFrame) -> DataFrame:
    """Edges with p_follow and action: r is the receiver's rank over the greatest among the case's edges; 0.5 + 0.49 r where
    both ends are inside the community, 0.49 r elsewhere."""
    rows = edges
    for end in ("src", "dst"):
        own = community.select("case_id", F.col("node").alias(end), F.col("inside").alias(f"__{end}"), F.col("rank").alias(f"__r_{end}"))
        rows = rows.join(own, ["case_id", end], "left")
    rows = rows.withColumn("__r", F.coalesce("__r_dst", F.lit(0.0)))
    rows = with_summary(rows, ["case_id"], __most=F.max("__r"))
    r = F.when(F.col("__most") > 0, F.col("__r") / F.col("__most")).otherwise(0.0)
    both = F.coalesce(F.col("__src") & F.col("__dst"), F.lit(False))
    rows = rows.withColumn("p_follow", F.when(both, 0.5 + 0.49 * r).otherwise(0.49 * r))
    return rows.withColumn("action", F.when(F.col("p_follow") >= 0.5, "follow").otherwise("ignore")).drop("__src", "__dst", "__r_src", "__r_dst", "__r", "__most")


def rated_transfers(edges: DataFrame, plus: bool = False) -> DataFrame:
    """Transfers with rating (see ``burst_rating``), its bin and ``temporal``: the rating, or with ``plus`` rating x (1 + gini
    of the month's days) x (1 + rise against the active day before, as a share of the month).

    Amounts that are not above zero count as 1. A month of a receiver and unit has at most 31 days, so its windows over days
    are small.
    """
    rows = edges.withColumn("amount", F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(1).cast("decimal(18,4)")))
    rated = burst_rating(rows).withColumn("bin", F.least(F.lit(RATING_BINS - 1), F.floor(F.col("rating") * RATING_BINS)).cast("int"))
    if not plus:
        return rated.withColumn("temporal", F.col("rating"))
    keys = ["case_id", "dst", "asset", "month"]
    rated = rated.withColumn("day", F.floor(F.col("ts") / DAY))
    days = rated.groupBy(*keys, "day").agg(F.sum("amount").cast("double").alias("volume"))
    unit = Window.partitionBy(*keys)
    days = days.withColumns({"__place": F.row_number().over(unit.orderBy("volume", "day")), "__n": F.count("*").over(unit), "__sum": F.sum("volume").over(unit), "__before": F.coalesce(F.lag("volume").over(unit.orderBy("day")), F.lit(0.0))})
    gini = 2 * F.sum(F.col("__place") * F.col("volume")).over(unit) / (F.col("__n") * F.col("__sum")) - (F.col("__n") + 1) / F.col("__n")
    days = days.select(*keys, "day", F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini)).alias("__gini"), (F.greatest(F.lit(0.0), F.col("volume") - F.col("__before")) / F.col("__sum")).alias("__rise"))
    return rated.join(days, [*keys, "day"]).withColumn("temporal", F.col("rating") * (1 + F.col("__gini")) * (1 + F.col("__rise"))).drop("day", "__gini", "__rise")


def _divergence(inside: list[Column], outside: list[Column]) -> Column:
    """Kullback-Leibler divergence of two histograms, smoothed by 1e-9 a bin; 0 where one is empty."""
    smooth = 1e-9
    a, b = reduce(add, inside), reduce(add, outside)
    share = lambda x, total: (x + smooth) / (total + smooth * len(inside))
    terms = [share(x, a) * F.log(share(x, a) / share(y, b)) for x, y in zip(inside, outside)]
    return F.when((a > 0) & (b > 0), reduce(add, terms)).otherwise(0.0)


def suspiciousness(base: float = 2.0) -> Column:
    """Score of a receiver from its counts, temporal weights and histograms within a set and in all.

    n x base ^ (alpha + beta + gamma - 3) of the n transfers from within, the exponent held between -12 and 3: alpha and beta
    are the shares of transfers and of temporal weight from within, gamma grows with the divergence of the ratings from
    within and from outside where both are alike in number.
    """
    n, total = F.col("n"), F.col("all_n")
    inside, outside = [F.col(f"b{i}") for i in range(RATING_BINS)], [F.col(f"all_b{i}") - F.col(f"b{i}") for i in range(RATING_BINS)]
    beta = F.when(F.col("all_t") > 0, F.col("t") / F.col("all_t")).otherwise(0.0)
    rest = total - n
    gamma = F.when(rest > 0, F.least(n / rest, rest / n) * (1 - F.exp(-F.greatest(F.lit(0.0), _divergence(inside, outside))))).otherwise(0.0)
    exponent = F.greatest(F.lit(-12.0), F.least(F.lit(3.0), n / total + beta + gamma - 3))
    return F.when((n > 0) & (total > 0), n * F.pow(F.lit(base), exponent)).otherwise(0.0)


def suspicious_passes(rated: DataFrame, base: float = 2.0, epsilon: float = 0.1, passes: int | None = None) -> DataFrame:
    """Nodes that are left in each pass, with their scores: case_id, pass, node, score, mean, size.

    A pass scores every node that is left by what reaches it from others that are left, then drops those at or below
    (1 + epsilon) x the case's mean. ``rated`` has case_id, src, dst, bin and temporal. Transfers of a pair are summed once:
    a count, a temporal weight and a histogram, which add up over senders; a pass only sums those of pairs that are left.
    """
    bins = {f"b{i}": F.sum((F.col("bin") == i).cast("long")) for i in range(RATING_BINS)}
    sums = {"n": F.count("*"), "t": F.sum("temporal"), **bins}
    pairs = kept(rated.where("src != dst").groupBy("case_id", "src", "dst").agg(*(c.alias(k) for k, c in sums.items())))
    whole = kept(pairs.groupBy("case_id", F.col("dst").alias("node")).agg(*(F.sum(k).alias(f"all_{k}") for k in sums)))
    alive = kept(pairs.select("case_id", F.explode(F.array("src", "dst")).alias("node")).distinct())
    history, old = None, []
    for p in count():  # a pass drops a node at least
        left = pairs
        for end in ("src", "dst"):
            left = left.join(alive.withColumnRenamed("node", end), ["case_id", end], "left_semi")
        left = kept(left)
        inner = left.groupBy("case_id", F.col("dst").alias("node")).agg(*(F.sum(k).alias(k) for k in sums))
        rows = alive.join(whole, ["case_id", "node"], "left").join(inner, ["case_id", "node"], "left").na.fill(0)
        scored = with_summary(rows.select("case_id", "node", suspiciousness(base).alias("score")), ["case_id"], mean=F.avg("score"), size=F.count("*"))
        scored = kept(scored.withColumn("pass", F.lit(p)))
        dropped(pairs, alive)
        history = scored if history is None else history.unionByName(scored)
        pairs, alive = left, kept(scored.where(F.col("score") > (1 + epsilon) * F.col("mean")).select("case_id", "node"))
        if p + 1 == passes or alive.isEmpty():
            dropped(pairs, alive, whole)
            return history.select("case_id", "pass", "node", "score", "mean", "size")
    raise AssertionError


def suspicious_set(rated: DataFrame, base: float = 2.0, epsilon: float = 0.1) -> DataFrame:
    """The pass with the greatest mean score of each case (the earlier one of equals): case_id, node, score, share of the
    greatest score, mean, size."""
    history = suspicious_passes(rated, base, epsilon)
    best = history.groupBy("case_id").agg(F.max_by("pass", F.struct("mean", -F.col("pass"))).alias("pass"))
    out = with_summary(history.join(best, ["case_id", "pass"]), ["case_id"], __most=F.max("score"))
    share = F.when(F.col("__most") > 0, F.col("score") / F.col("__most")).otherwise(0.0)
    return out.select("case_id", "node", "score", share.alias("share"), "mean", "size")


def push_flows(edges: DataFrame, symbol: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What pushes need, as tables: weights by node, receiver and symbol; degree and total of a node; its sum by symbol."""
    tag = F.lit("") if symbol is None else F.coalesce(symbol, F.lit(""))
    amount = F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(1)).cast("double")
    out = kept(edges.withColumn("via", tag).groupBy("case_id", F.col("src").alias("node"), F.col("dst").alias("to"), "via").agg(F.sum(amount).alias("w")))
    degree = kept(out.groupBy("case_id", "node").agg(F.count_distinct("to").alias("degree"), F.sum("w").alias("total")))
    own = kept(out.groupBy("case_id", "node", "via").agg(F.sum("w").alias("own")))
    return out, degree, own


def best_first_rank(edges: DataFrame, sources: DataFrame, expansions: int = 64, at_once: int = 1, alpha: float = 0.15, epsilon: float = 1e-3, beta: float = 0.7, symbol: str | None = None) -> DataFrame:
    """Approximate personalised rank with at most ``expansions`` pushes a case: case_id, node, rank, residual.

    Sources share a residual of 1. The node with the largest residual above epsilon x its out-degree pushes next, the
    smaller name first among equals: the part alpha stays as rank, the rest goes on by amounts, see ``graphs.push_rank``
    for symbols. With ``at_once`` > 1 so many of the largest push together, which takes fewer rounds and is no longer the
    sequential order. A round works on all cases; it ends early where no case has a node to push.
    """
    out, degree, own = push_flows(edges, symbol)
    starts = sources.select("case_id", "node").distinct()
    state = with_summary(starts, ["case_id"], __n=F.count("*")).select("case_id", "node", F.lit("").alias("held"), (1 / F.col("__n")).alias("residual"), F.lit(0.0).alias("rank"))
    state = kept(state)
    left = expansions
    while left > 0:
        sums = state.groupBy("case_id", "node").agg(F.sum("residual").alias("__r")).join(degree.select("case_id", "node", "degree"), ["case_id", "node"], "left")
        hot = sums.where((F.col("__r") > 0) & (F.col("__r") > epsilon * F.coalesce("degree", F.lit(1))))
        turn = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("__r"), "node"))
        chosen = kept(hot.withColumn("__turn", turn).where(F.col("__turn") <= min(at_once, left)).select("case_id", "node", F.lit(True).alias("__push")))
        if chosen.isEmpty():
            dropped(chosen)
            break
        left -= at_once
        rows = state.join(chosen, ["case_id", "node"], "left").join(degree, ["case_id", "node"], "left").join(own.withColumnRenamed("via", "held"), ["case_id", "node", "held"], "left")
        push = F.when(F.col("__push"), F.col("residual")).otherwise(0.0)
        stays = F.when(F.col("degree").isNull(), push).otherwise(alpha * push)
        stay = rows.select("case_id", "node", "held", (F.col("residual") - push).alias("residual"), (F.col("rank") + stays).alias("rank"))
        pushed = rows.where("__push and residual > 0").select("case_id", "node", "held", "residual", "total", F.col("own").alias("__own")).join(out, ["case_id", "node"])
        same = F.when(F.col("__own") >= F.col("total"), 1.0).otherwise(beta)
        share = F.when(F.col("__own").isNull(), F.col("w") / F.col("total")).when(F.col("held") == F.col("via"), same * F.col("w") / F.col("__own")).otherwise((1 - same) * F.col("w") / (F.col("total") - F.col("__own")))
        flow = pushed.select("case_id", F.col("to").alias("node"), F.col("via").alias("held"), ((1 - alpha) * F.col("residual") * share).alias("residual"), F.lit(0.0).alias("rank"))
        now = kept(stay.unionByName(flow).groupBy("case_id", "node", "held").agg(F.sum("residual").alias("residual"), F.sum("rank").alias("rank")))
        dropped(state, chosen)
        state = now
    result = kept(state.groupBy("case_id", "node").agg(F.sum("rank").alias("rank"), F.sum("residual").alias("residual")))
    dropped(state, out, degree, own)
    return result
