"""Iterative graph operators, for all cases at once.

Each iteration is a join and an aggregation whose result goes to a table in the shared folder, so that plans stay
short and lost executors cost one iteration.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import neighbors
from .relational import dropped, kept, last_before, numbered, running_sums, top_n_per_group, with_summary


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes (case_id, node, step) that the seeds (case_id, node) reach along src to dst, with the least number of steps.

    Goes on until no node is new, or for ``depth`` steps.
    """
    steps = edges.select("case_id", F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    frontier = seen = kept(seeds.select("case_id", "node").distinct().withColumn("step", F.lit(0)))
    n = 0
    while depth is None or n < depth:
        n += 1
        to = steps.join(frontier.select("case_id", "node"), ["case_id", "node"]).select("case_id", F.col("to").alias("node")).distinct()
        new = kept(to.join(seen, ["case_id", "node"], "left_anti").withColumn("step", F.lit(n)))
        if new.isEmpty():
            dropped(new)
            break
        grown = kept(seen.unionByName(new))
        dropped(*({seen, frontier}))
        seen, frontier = grown, new
    if frontier is not seen:
        dropped(frontier)
    return seen


def unreachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges whose source no seed reaches along the edges."""
    seen = reachable(edges, seeds).select("case_id", F.col("node").alias("src"))
    return edges.join(seen, ["case_id", "src"], "left_anti")


def corridor(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges on paths from a source to a target: forward reach of the sources meets backward reach of the targets."""
    ahead = reachable(edges, sources).select("case_id", F.col("node").alias("src"))
    back = reachable(edges.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst")), targets).select("case_id", F.col("node").alias("dst"))
    return edges.join(ahead, ["case_id", "src"], "left_semi").join(back, ["case_id", "dst"], "left_semi")


def corridor_scores(edges: DataFrame, sources: DataFrame, targets: DataFrame, bucket: str = "asset") -> DataFrame:
    """Pairs of nodes by bucket of value: summed capacity, and p_follow of 0.99 where they lie on a path of one bucket from a
    source to a target that is no source, 0.01 elsewhere: case_id, bucket, src, dst, capacity, p_follow, action.

    Amounts of different buckets do not mix: a path stays in its bucket.
    """
    split = edges.withColumn("bucket", F.coalesce(bucket, F.lit(""))).groupBy("case_id", "bucket", "src", "dst").agg(F.sum("amount").alias("capacity"))
    keyed = split.withColumn("case_id", F.struct("case_id", "bucket"))
    buckets = split.select("case_id", "bucket").distinct()
    ends = lambda nodes: nodes.select("case_id", "node").distinct().join(buckets, "case_id").select(F.struct("case_id", "bucket").alias("case_id"), "node")
    far = targets.select("case_id", "node").distinct().join(sources.select("case_id", "node").distinct(), ["case_id", "node"], "left_anti")
    on_path = corridor(keyed, ends(sources), ends(far)).select("case_id", "src", "dst", F.lit(0.99).alias("p_follow"))
    out = keyed.join(on_path, ["case_id", "src", "dst"], "left").withColumn("p_follow", F.coalesce("p_follow", F.lit(0.01)))
    return out.select("case_id.*", "src", "dst", "capacity", "p_follow", F.when(F.col("p_follow") >= 0.5, "follow").otherwise("ignore").alias("action"))


def enrich_outgoing(actionable: DataFrame, transfers: DataFrame, n: int) -> DataFrame:
    """Up to n outgoing transfers of each source of actionable edges that are not among them; hop is the source's least."""
    sources = actionable.groupBy("case_id", F.col("src").alias("address")).agg(F.min("hop").alias("hop"))
    near = neighbors(transfers, sources.select("case_id", "address"), n, "out")
    fresh = near.join(actionable.select("case_id", "edge_id"), ["case_id", "edge_id"], "left_anti")
    return fresh.join(sources, ["case_id", "address"]).select("case_id", "edge_id", "src", "dst", "hop")


def successors(edges: DataFrame) -> DataFrame:
    """Each transfer with the first one that leaves its receiver later (edge_id, next_id); an as-of join over one sorted stream."""
    arrive = edges.select("case_id", F.col("dst").alias("node"), "ts", F.lit(0).alias("kind"), "edge_id", F.lit(None).cast("string").alias("leaves"))
    leave = edges.select("case_id", F.col("src").alias("node"), "ts", F.lit(1).alias("kind"), "edge_id", F.col("edge_id").alias("leaves"))
    # From late to early; at equal times arrivals come first, so that only later departures have been seen.
    seen = last_before(arrive.unionByName(leave), ["case_id", "node"], [F.desc("ts"), "kind", F.desc("edge_id")], "leaves", "next_id")
    return seen.where("kind = 0").select("case_id", "edge_id", "next_id")


def claimed_chains(edges: DataFrame, most: int = 40) -> DataFrame:
    """Transfers by chain: case_id, edge_id, chain_id, place. Each transfer, in the order of time and id, starts a chain unless
    one that started before has taken it; a chain follows successors until it meets one that is taken.

    As a transfer has one successor, a chain takes what the earliest transfer above it reaches: pointers are doubled, and
    each transfer keeps the earliest start that has come down to it, with the number of steps from there.
    """
    step = successors(edges).join(edges.select("case_id", "edge_id", "ts"), ["case_id", "edge_id"])
    at = kept(step.select("case_id", "edge_id", F.col("next_id").alias("jump"), F.struct("ts", F.col("edge_id").alias("start"), F.lit(0).cast("long").alias("steps")).alias("best")))
    for n in range(most):
        moving = at.where("jump IS NOT NULL")
        if moving.isEmpty():
            return at.select("case_id", "edge_id", F.col("best.start").alias("chain_id"), F.col("best.steps").alias("place"))
        down = moving.groupBy("case_id", F.col("jump").alias("edge_id")).agg(F.min(F.struct("best.ts", "best.start", (F.col("best.steps") + (1 << n)).alias("steps"))).alias("__came"))
        far = at.select("case_id", F.col("edge_id").alias("jump"), F.col("jump").alias("__far"))
        now = at.join(down, ["case_id", "edge_id"], "left").join(far, ["case_id", "jump"], "left")
        now = kept(now.select("case_id", "edge_id", F.col("__far").alias("jump"), F.least("best", F.coalesce("__came", "best")).alias("best")))
        dropped(at)
        at = now
    raise RuntimeError("chains have a cycle")


def arrivals(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes (case_id, node, arrival) that the seeds reach along transfers in the order of time, with the earliest time.

    A transfer leads on only if it is not before the arrival at its source; seeds are there from the start (null). Each
    round relaxes the transfers of nodes whose arrival became earlier, until none does. Transfers without a time lead nowhere.
    """
    start = F.lit(-(1 << 62))
    steps = edges.where("ts IS NOT NULL").select("case_id", F.col("src").alias("node"), F.col("dst").alias("to"), "ts")
    seen = kept(seeds.select("case_id", "node").distinct().withColumn("arrival", start))
    frontier, first = seen, seen
    while True:
        near = steps.join(frontier, ["case_id", "node"]).where("ts >= arrival").groupBy("case_id", F.col("to").alias("node")).agg(F.min("ts").alias("now"))
        better = near.join(seen, ["case_id", "node"], "left").where("arrival IS NULL OR now < arrival").select("case_id", "node", F.col("now").alias("arrival"))
        frontier = kept(better)
        if frontier.isEmpty():
            dropped(frontier)
            return seen.select("case_id", "node", F.when(F.col("arrival") != start, F.col("arrival")).alias("arrival"))
        grown = kept(seen.unionByName(frontier).groupBy("case_id", "node").agg(F.min("arrival").alias("arrival")))
        if seen is not first:
            dropped(seen)
        seen = grown


def unreached_in_order(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that no seed reaches through earlier edges: the source is not reached, or only after the edge."""
    seen = arrivals(edges, seeds).select("case_id", F.col("node").alias("src"), "arrival", F.lit(True).alias("__seen"))
    out = edges.join(seen, ["case_id", "src"], "left")
    return out.where("__seen IS NULL OR ts IS NULL AND arrival IS NOT NULL OR ts < arrival").drop("__seen", "arrival")


def chains(edges: DataFrame, most: int = 40) -> DataFrame:
    """Last transfer and length of the chain that starts at each transfer, by doubling pointers."""
    at = kept(successors(edges).select("case_id", "edge_id", F.coalesce("next_id", "edge_id").alias("end"), F.when(F.col("next_id").isNull(), 0).otherwise(1).cast("long").alias("length")))
    for _ in range(most):
        far = at.select("case_id", F.col("edge_id").alias("end"), F.col("end").alias("far"), F.col("length").alias("more"))
        now = kept(at.join(far, ["case_id", "end"]).select("case_id", "edge_id", F.col("far").alias("end"), (F.col("length") + F.col("more")).alias("length"), (F.col("more") > 0).alias("moved")))
        dropped(at)
        at = now
        if at.where("moved").isEmpty():
            return at.drop("moved")
    raise RuntimeError("chains have a cycle")


def gold_paths(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Paths of 1 to ``depth`` edges from the starts (case_id, node) without meeting a node twice; those that cannot go on, or are as long as allowed."""
    step = edges.select("case_id", F.col("src").alias("node"), "edge_id", F.col("dst").alias("to"))
    at = starts.select("case_id", "node").distinct().withColumns({"path": F.array().cast("array<string>"), "seen": F.array("node"), "start": F.col("node")})
    done = None
    for n in range(1, depth + 1):
        near = at.join(step, ["case_id", "node"]).where(~F.array_contains("seen", F.col("to")))
        grown = kept(near.select("case_id", "start", F.col("to").alias("node"), F.concat("path", F.array("edge_id")).alias("path"), F.concat("seen", F.array("to")).alias("seen")))
        # A path ends where no edge leads on to an unseen node; the paths that went on are their longer selves' prefixes.
        if n > 1:
            went = grown.select("case_id", "start", F.slice("path", 1, n - 1).alias("path")).distinct()
            ended = at.join(went, ["case_id", "start", "path"], "left_anti").select("case_id", "start", "path")
            done = ended if done is None else done.unionByName(ended)
        at = grown
    last = at.select("case_id", "start", "path")
    return last if done is None else done.unionByName(last)


def beam_rollout(candidates: DataFrame, starts: DataFrame, threshold: float = 0.5, depth: int = 3, beam: int = 3, expansions: int = 64) -> DataFrame:
    """Most probable paths of follow edges: case_id, path, probability, reason (dead_end, no_follow or budget).

    ``candidates`` has case_id, src, dst, edge_id, p_follow. A depth keeps the ``beam`` best of a case; nodes are not
    met twice; a case expands ``expansions`` nodes at most, counted in the order of probability.
    """
    # Edges to follow are written once; what other edges lead on from is asked once, for the nodes where paths end.
    step = kept(candidates.where(F.col("p_follow") >= threshold).select("case_id", F.col("src").alias("node"), "edge_id", F.col("dst").alias("to"), F.col("p_follow").alias("p")))
    at = starts.select("case_id", "node").distinct().withColumns({"path": F.array().cast("array<string>"), "seen": F.array("node"), "probability": F.lit(1.0), "used": F.lit(0)})
    out, rounds = None, [step]

    def ended(rows: DataFrame, reason: str, where_it_ends: str) -> DataFrame:
        return rows.select("case_id", "node", "path", "probability", F.lit(reason).alias("reason"), F.lit(where_it_ends).alias("end"))

    for _ in range(depth):
        order = Window.partitionBy("case_id").orderBy(F.desc("probability"), F.concat_ws(",", "path"))
        counted = at.withColumn("turn", F.col("used") + F.row_number().over(order))
        over = counted.where(F.col("turn") > expansions)
        able = counted.where(F.col("turn") <= expansions).withColumn("used", F.max("turn").over(Window.partitionBy("case_id"))).drop("turn")
        near = able.join(step, ["case_id", "node"]).where(~F.array_contains("seen", F.col("to")))
        grown = near.select("case_id", F.col("to").alias("node"), F.concat("path", F.array("edge_id")).alias("path"), F.concat("seen", F.array("to")).alias("seen"), (F.col("probability") * F.col("p")).alias("probability"), "used", F.col("path").alias("parent"))
        went = grown.select("case_id", F.col("parent").alias("path")).distinct()
        stuck = able.join(went, ["case_id", "path"], "left_anti")
        part = ended(over, "budget", "budget").unionByName(ended(stuck, "no_follow", "dead_end"))
        out = part if out is None else out.unionByName(part)
        at = kept(top_n_per_group(grown.drop("parent"), ["case_id"], [F.desc("probability"), F.concat_ws(",", "path")], beam))
        rounds.append(at)
    out = kept(out.unionByName(ended(at, "budget", "dead_end")).where(F.size("path") > 0))
    leads = candidates.select("case_id", F.col("src").alias("node")).join(out.select("case_id", "node").distinct(), ["case_id", "node"], "left_semi").distinct().withColumn("leads", F.lit(True))
    result = kept(out.join(leads, ["case_id", "node"], "left").select("case_id", "path", "probability", F.when(F.col("leads"), F.col("reason")).otherwise(F.col("end")).alias("reason")))
    dropped(out, *rounds)
    return result


def state_rollout(states: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """States (case_id, node, depth) met from the seeds along selected edges (case_id, src, dst)."""
    return reachable(states, seeds, depth).withColumnRenamed("step", "depth")


def push_rank(edges: DataFrame, sources: DataFrame, alpha: float = 0.15, epsilon: float = 1e-3, beta: float = 0.7, symbol: str | None = None) -> DataFrame:
    """Approximate personalised rank by case: residuals above epsilon x degree push their rest along the outgoing amounts, all at once.

    With a ``symbol`` (asset or token), a residual remembers the one it came by: the part ``beta`` goes on along edges of that
    symbol and the rest along the others; where a node has only one kind, that takes all. Rounds go on until no residual
    is above its bound: each takes the part alpha of what is pushed out of play. Adds up to at most 1 a case.
    """
    tag = F.lit("") if symbol is None else F.coalesce(symbol, F.lit(""))
    out = edges.withColumn("via", tag).groupBy("case_id", F.col("src").alias("node"), F.col("dst").alias("to"), "via").agg(F.sum("amount").cast("double").alias("w"))
    out = kept(out)
    degree = out.groupBy("case_id", "node").agg(F.count_distinct("to").alias("degree"), F.sum("w").alias("total"))
    own = out.groupBy("case_id", "node", "via").agg(F.sum("w").alias("own"))
    degree = kept(degree)
    flows = kept(out.join(own, ["case_id", "node", "via"]).join(degree.select("case_id", "node", "total"), ["case_id", "node"]))
    starts = sources.select("case_id", "node").distinct()
    n = starts.groupBy("case_id").agg(F.count("*").alias("n"))
    state = kept(starts.join(n, "case_id").select("case_id", "node", F.lit("").alias("held"), (1 / F.col("n")).alias("residual"), F.lit(0.0).alias("rank")))
    own = kept(own)
    dropped(out)
    while True:
        rows = state.join(degree, ["case_id", "node"], "left").join(own.withColumnRenamed("via", "held"), ["case_id", "node", "held"], "left")
        hot = F.col("residual") > epsilon * F.coalesce("degree", F.lit(1))
        moved = kept(rows.withColumn("push", F.when(hot, F.col("residual")).otherwise(0.0)))
        if moved.where("push > 0").isEmpty():
            result = kept(moved.groupBy("case_id", "node").agg(F.sum("rank").alias("rank"), F.sum("residual").alias("residual")))
            dropped(moved, state, degree, flows, own)
            return result
        stay = moved.select("case_id", "node", "held", (F.col("residual") - F.col("push")).alias("residual"), (F.col("rank") + alpha * F.col("push") + F.when(F.col("degree").isNull(), (1 - alpha) * F.col("push")).otherwise(0.0)).alias("rank"))
        # Shares of the edges of the symbol that is held, and of all others.
        same = F.when(F.col("o") >= F.col("total"), 1.0).otherwise(beta)
        share = F.when(F.col("o").isNull(), F.col("w") / F.col("total")).when(F.col("held") == F.col("via"), same * F.col("w") / F.col("o")).otherwise((1 - same) * F.col("w") / (F.col("total") - F.col("o")))
        pushed = moved.where("push > 0").select("case_id", "node", "held", F.col("own").alias("o"), "push").join(flows.drop("own"), ["case_id", "node"])
        flow = pushed.select("case_id", F.col("to").alias("node"), F.col("via").alias("held"), ((1 - alpha) * F.col("push") * share).alias("residual"), F.lit(0.0).alias("rank"))
        now = kept(stay.unionByName(flow).groupBy("case_id", "node", "held").agg(F.sum("residual").alias("residual"), F.sum("rank").alias("rank")))
        dropped(state, moved)
        state = now


def conductance_sweep(edges: DataFrame, ranks: DataFrame, phi: float = 0.5) -> DataFrame:
    """Nodes by falling rank, and whether they are in the first prefix of their case whose conductance is below phi (else in the one with the least).

    Conductance of a prefix: edges that leave it over the smaller of its volume and the rest's. An edge is inside from the
    place of its later end on, so running sums over places give all prefixes.
    """
    ranked = numbered(ranks.withColumn("__falling", -F.col("rank")), ["case_id"], ["__falling", "node"], "place").drop("__falling")
    pairs = edges.where("src != dst").groupBy("case_id", "src", "dst").agg(F.count("*").alias("w"))
    ends = pairs
    for end in ("src", "dst"):
        ends = ends.join(ranked.select("case_id", F.col("node").alias(end), F.col("place").alias(f"p_{end}")), ["case_id", end], "left")
    far = F.lit(2**31 - 1)
    ends = ends.withColumns({"first": F.least(F.coalesce("p_src", far), F.coalesce("p_dst", far)), "last": F.greatest(F.coalesce("p_src", far), F.coalesce("p_dst", far))})
    enter = ends.select("case_id", F.col("first").alias("place"), F.col("w").alias("cut"), F.col("w").alias("volume"))
    close = ends.select("case_id", F.col("last").alias("place"), (-F.col("w")).alias("cut"), F.col("w").alias("volume"))
    delta = enter.unionByName(close).groupBy("case_id", "place").agg(F.sum("cut").alias("cut"), F.sum("volume").alias("volume"))
    total = pairs.groupBy("case_id").agg((2 * F.sum("w")).alias("all"))
    rows = ranked.join(delta, ["case_id", "place"], "left").join(total, "case_id").na.fill(0, ["cut", "volume"])
    rows = running_sums(rows, ["case_id"], "place", ["cut", "volume"])
    rows = rows.withColumn("conductance", F.coalesce(F.try_divide(F.col("cut"), F.least(F.col("volume"), F.col("all") - F.col("volume"))), F.lit(1.0)))
    under, least = F.min(F.when(F.col("conductance") < phi, F.col("place"))), F.min_by("place", F.struct("conductance", "place"))
    rows = with_summary(rows, ["case_id"], __last=F.coalesce(under, least))
    return rows.withColumn("inside", F.col("place") <= F.col("__last")).select("case_id", "node", "rank", "place", "conductance", "inside")


def dense_peel(edges: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """Densest set of nodes by case under weights: passes drop all nodes at or below (1 + epsilon) x the mean degree; the best pass stands.

    Passes grow with the logarithm of the number of nodes, and the weight an inside node keeps is at least 1 / (2 + 2 epsilon)
    of the best.
    """
    pairs = kept(edges.where("src != dst").groupBy("case_id", "src", "dst").agg(F.sum("amount").cast("double").alias("w")))
    alive = kept(pairs.select("case_id", F.explode(F.array("src", "dst")).alias("node")).distinct())
    history = None
    for n in count():  # a pass drops a node at least
        left = pairs
        for end in ("src", "dst"):
            left = left.join(alive.withColumnRenamed("node", end), ["case_id", end], "left_semi")
        left = kept(left)
        dropped(pairs)
        pairs = left
        half = pairs.select("case_id", F.explode(F.array("src", "dst")).alias("node"), "w")
        degree = alive.join(half.groupBy("case_id", "node").agg(F.sum("w").alias("d")), ["case_id", "node"], "left").na.fill(0.0, ["d"])
        mean = degree.groupBy("case_id").agg(F.avg("d").alias("mean"), F.count("*").alias("size"))
        scored = kept(degree.join(mean, "case_id").withColumns({"density": F.col("mean") / 2, "pass": F.lit(n)}))
        history = scored if history is None else history.unionByName(scored)
        dropped(alive)
        alive = kept(scored.where(F.col("d") > (1 + epsilon) * F.col("mean")).select("case_id", "node"))
        if alive.isEmpty():
            break
    dropped(pairs, alive)
    best = history.groupBy("case_id").agg(F.max_by("pass", F.struct(F.col("density"), -F.col("pass"))).alias("pass"))
    return history.join(best, ["case_id", "pass"]).select("case_id", "node", "density", "size")
