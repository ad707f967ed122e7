"""Reported flows held against observed transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import last_before, top_n_per_group


def resolve_reported(reported: DataFrame, addresses: DataFrame) -> DataFrame:
    """Reported ends to addresses: those of the entity, all pairs of both ends, else the end itself where it is an address.

    ``addresses`` has case_id, entity_id, address. A side that resolves to nothing is null; rows with two such are dropped.
    """
    out = reported
    for end in ("src", "dst"):
        side = addresses.select("case_id", F.col("entity_id").alias(end), F.col("address").alias(f"{end}_entity"))
        out = out.join(side, ["case_id", end], "left")
        own = F.when(F.col(end).rlike("^0x[0-9a-f]{40}$"), F.col(end))
        out = out.withColumn(f"{end}_address", F.coalesce(f"{end}_entity", own)).drop(f"{end}_entity")
    return out.where("src_address is not null or dst_address is not null")


def positive_pairs(transactions: DataFrame) -> DataFrame:
    """Distinct (case_id, src, dst) of evidence whose label speaks of an outflow."""
    return transactions.where(F.lower("label").rlike("attacker|outflow|transfer_from")).select("case_id", "src", "dst").distinct()


def pair_or_reverse(edges: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """``edges`` with a value by (src, dst), else by (dst, src): two equi-joins in place of an OR."""
    ahead = pairs.select("case_id", "src", "dst", F.col(value).alias("__ahead"))
    back = pairs.select("case_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col(value).alias("__back"))
    out = edges.join(ahead, ["case_id", "src", "dst"], "left").join(back, ["case_id", "src", "dst"], "left")
    return out.withColumn(value, F.coalesce("__ahead", "__back")).drop("__ahead", "__back")


def touches(edges: DataFrame, nodes: DataFrame, name: str = "touches_seed") -> DataFrame:
    """Whether an end of an edge is among the nodes (case_id, node)."""
    out = edges
    for end in ("src", "dst"):
        mark = nodes.select("case_id", F.col("node").alias(end), F.lit(True).alias(f"__{end}")).distinct()
        out = out.join(mark, ["case_id", end], "left")
    return out.withColumn(name, F.col("__src").isNotNull() | F.col("__dst").isNotNull()).drop("__src", "__dst")


def attribution(entities: DataFrame) -> DataFrame:
    """Address to role, with the number of entities that claim it; more than one is a conflict."""
    return entities.groupBy("case_id", "address").agg(F.count_distinct("entity_id").alias("n_entities"), F.min("entity_id").alias("entity_id"), F.min_by("role", "entity_id").alias("role"))


def match_transactions(reported: DataFrame, transfers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Reported flows with transfers of their case whose amount is within the tolerance, and the reasons for a match.

    Amounts are cut into bins of the tolerance's width on a log scale; a flow looks into its own bin and its two
    neighbours, so that the range join is an equi-join.
    """
    wide = float(2 * tolerance)
    place = lambda c: F.floor(F.log(F.greatest(F.col(c).cast("double"), F.lit(1e-6))) / F.lit(wide)).cast("long")
    left = reported.withColumn("bin", F.explode(F.array(*(place("amount") + i for i in (-1, 0, 1)))))
    right = transfers.select("case_id", F.col("edge_id").alias("tx_edge"), F.col("src").alias("tx_src"), F.col("dst").alias("tx_dst"), F.col("amount").alias("tx_amount"), F.col("asset").alias("tx_asset"), F.col("ts").alias("tx_ts")).withColumn("bin", place("tx_amount"))
    both = left.join(right, ["case_id", "bin"]).where(F.abs(F.col("tx_amount") - F.col("amount")).cast("double") <= F.col("amount").cast("double") * tolerance)
    return both.drop("bin").withColumn("reasons", match_reasons())


def reasoned_matches(reported: DataFrame, transfers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The rows of ``match_transactions`` that have a reason, without the pairs that have none.

    All reasons but the same amount, which lies in the same bin, are equal values of both sides. So rows meet by bin and by
    what makes a reason: the source, the pair turned round, the asset or the amount; a pair that meets by several is kept
    where the first of them brought it.
    """
    wide = float(2 * tolerance)
    place = lambda c: F.floor(F.log(F.greatest(F.col(c).cast("double"), F.lit(1e-6))) / F.lit(wide)).cast("long")

    def ways(source, turned, asset, amount):
        # A null makes no reason, so its key is left out.
        keys = [("source", F.col(source)), ("turned", F.concat(F.col(turned[0]), F.lit(">"), F.col(turned[1]))), ("asset", F.col(asset)), ("amount", F.col(amount).cast("decimal(38,10)").cast("string"))]
        return F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("way"), v.alias("value")) for i, (_, v) in enumerate(keys))), lambda x: x["value"].isNotNull())).alias("key")

    left = reported.withColumn("key", ways("src", ("dst", "src"), "asset", "amount")).withColumn("bin", F.explode(F.array(*(place("amount") + i for i in (-1, 0, 1)))))
    right = transfers.select("case_id", F.col("edge_id").alias("tx_edge"), F.col("src").alias("tx_src"), F.col("dst").alias("tx_dst"), F.col("amount").alias("tx_amount"), F.col("asset").alias("tx_asset"), F.col("ts").alias("tx_ts"))
    right = right.withColumn("key", ways("tx_src", ("tx_src", "tx_dst"), "tx_asset", "tx_amount")).withColumn("bin", place("tx_amount"))
    both = left.join(right, ["case_id", "bin", "key"]).where(F.abs(F.col("tx_amount") - F.col("amount")).cast("double") <= F.col("amount").cast("double") * tolerance)
    same = [F.col("src") == F.col("tx_src"), (F.col("src") == F.col("tx_dst")) & (F.col("dst") == F.col("tx_src")), F.col("asset") == F.col("tx_asset"), F.col("amount") == F.col("tx_amount")]
    brought = F.array_position(F.array(*(F.coalesce(c, F.lit(False)) for c in same)), True) - 1
    return both.where(F.col("key.way") == brought).drop("bin", "key").withColumn("reasons", match_reasons())


def match_reasons():
    reason = lambda c, name: F.when(c, F.lit(name))
    return F.array_compact(
        F.array(
            reason((F.col("src") == F.col("tx_src")) & (F.col("dst") == F.col("tx_dst")), "same_pair"),
            reason((F.col("src") == F.col("tx_dst")) & (F.col("dst") == F.col("tx_src")), "reverse_pair"),
            reason(F.col("src") == F.col("tx_src"), "same_source"),
            reason(F.col("asset") == F.col("tx_asset"), "same_asset"),
            reason(F.col("amount") == F.col("tx_amount"), "same_amount"),
        )
    )


def missing_references(edges: DataFrame, entities: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Ends of edges that no entity holds, as stubs."""
    ends = edges.select("case_id", F.explode(F.array(source, target)).alias("address")).distinct()
    lost = ends.join(entities.select("case_id", "address").distinct(), ["case_id", "address"], "left_anti")
    kind = F.when(F.col("address").rlike("^0x[0-9a-f]{40}$"), "address").otherwise("reference")
    return lost.select("case_id", "address", kind.alias("type"))


def merge_mappings(mappings: DataFrame) -> DataFrame:
    """Mappings of one (case, chain, address, role) as one: evidence united, best confidence, widest span of blocks."""
    return mappings.groupBy("case_id", "chain", "address", "role").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
        F.min("confidence").alias("confidence"),
        F.min("from_block").alias("from_block"),
        F.max("to_block").alias("to_block"),
        F.count("*").alias("n_mappings"),
    )


def keyword_sources(rows: DataFrame, sources: DataFrame, keyword: str, text: str, n: int = 5) -> DataFrame:
    """First n sources whose text holds a row's keyword, by position. Sources are a short list of a case."""
    hit = rows.join(sources, F.contains(F.lower(F.col(text)), F.lower(F.col(keyword))))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy(*rows.columns).orderBy("pos"))).where(F.col("place") <= n)


def two_hop_paths(edges: DataFrame) -> DataFrame:
    """Each edge with the first other edge that leaves its end, not before it; equal times count, by id.

    An as-of join over one sorted stream of arrivals and departures, from late to early; of equal times departures come
    first. An edge that comes back to where it starts may find itself; it also looks just before its own departure.
    """
    look = F.lit(None).cast("string")
    row = lambda node, kind, leaves: edges.select("case_id", F.col(node).alias("node"), "ts", F.lit(kind).alias("kind"), "edge_id", leaves.alias("leaves"))
    again = edges.where("src = dst").select("case_id", F.col("src").alias("node"), "ts", F.lit(0).alias("kind"), "edge_id", look.alias("leaves"))
    stream = row("src", 0, F.col("edge_id")).unionByName(row("dst", 1, look)).unionByName(again)
    stream = stream.withColumn("own", F.col("leaves").isNotNull())
    seen = last_before(stream, ["case_id", "node"], [F.desc("ts"), "kind", F.desc("edge_id"), "own"], "leaves", "next").where("NOT own")
    other, behind = F.max(F.when((F.col("kind") == 1) & (F.col("next") != F.col("edge_id")), F.col("next"))), F.max(F.when(F.col("kind") == 0, F.col("next")))
    found = seen.groupBy("case_id", F.col("edge_id").alias("first_edge")).agg(F.coalesce(other, behind).alias("second_edge"))
    return found.where("second_edge IS NOT NULL")


def stage_sequences(edges: DataFrame, cap: int = 24) -> DataFrame:
    """Pairs of a source's edges in order whose stages differ, at most ``cap`` a case (the inventory's own limit).

    The first ``cap`` pairs of a source begin at its first ``cap`` edges, as each of them has a later edge of another stage
    or ends the pairs, and end within the first 2 x ``cap`` edges of a stage; no others are joined.
    """
    at = Window.partitionBy("case_id", "src").orderBy("ts", "reported_id")
    rows = edges.withColumn("i", F.row_number().over(at))
    near = top_n_per_group(rows, ["case_id", "src", "stage"], [F.col("i")], 2 * cap)
    a = near.where(F.col("i") <= cap).select("case_id", "src", F.col("i").alias("i1"), F.col("stage").alias("s1"), F.col("reported_id").alias("e1"))
    b = near.select("case_id", "src", F.col("i").alias("i2"), F.col("stage").alias("s2"), F.col("reported_id").alias("e2"))
    both = a.join(b, ["case_id", "src"]).where("i1 < i2 and s1 != s2")
    return top_n_per_group(both, ["case_id"], [F.col("src"), F.col("i1"), F.col("i2")], cap).select("case_id", "e1", "e2")


def line_graph(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Weights between edges that share an end; every edge meets itself.

    Undirected: 1 / sqrt(degree x degree). Directed: an edge looks back at those not later than it, evenly.
    Edges meet at their nodes; how many pairs a node makes is the square of its degree, as the result has them all.
    """
    if directed:
        a = edges.select("case_id", F.col("edge_id").alias("e1"), F.col("src").alias("node"), F.col("ts").alias("t1"))
        b = edges.select("case_id", F.col("edge_id").alias("e2"), F.col("dst").alias("node"), F.col("ts").alias("t2"))
        pairs = a.join(b, ["case_id", "node"]).where("t2 <= t1 and e1 != e2").select("case_id", "e1", "e2").distinct()
        pairs = pairs.unionByName(edges.select("case_id", F.col("edge_id").alias("e1"), F.col("edge_id").alias("e2")))
        n = pairs.groupBy("case_id", "e1").agg(F.count("*").alias("n"))
        return pairs.join(n, ["case_id", "e1"]).select("case_id", "e1", "e2", (1 / F.col("n")).alias("weight"))
    ends = edges.select("case_id", F.col("edge_id").alias("e1"), F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    pairs = ends.join(ends.withColumnRenamed("e1", "e2"), ["case_id", "node"]).select("case_id", "e1", "e2").distinct()
    n = pairs.groupBy("case_id", "e1").agg(F.count("*").alias("n"))
    out = pairs.join(n.withColumnRenamed("n", "n1"), ["case_id", "e1"]).join(n.select("case_id", F.col("e1").alias("e2"), F.col("n").alias("n2")), ["case_id", "e2"])
    return out.select("case_id", "e1", "e2", (1 / F.sqrt(F.col("n1") * F.col("n2"))).alias("weight"))


def reconcile(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Status of each key: confirmed, discrepancy (with the columns that differ) or unverifiable."""
    a, b = stored.alias("a"), fresh.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    gone = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    status = F.when(gone, "unverifiable").when(F.size(differ) == 0, "confirmed").otherwise("discrepancy")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"), F.when(gone, F.array().cast("array<string>")).otherwise(differ).alias("differs"))
