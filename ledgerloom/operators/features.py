"""Window features of transfers and line-graph features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import top_n_per_group, with_summary

DAY = 86400


def edge_features(edges: DataFrame) -> DataFrame:
    """Features of a transfer among its source's: share of the outflow, ranks by amount and by time, degrees, flags."""
    src, dst = Window.partitionBy("case_id", "src"), Window.partitionBy("case_id", "dst")
    amount = F.col("amount").cast("double")
    total = F.sum("amount").over(src).cast("double")
    far = F.lit(2**62)
    late = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(far)
    return edges.withColumns(
        {
            "log_amount": F.log1p(amount),
            "share": F.when(total > 0, amount / total).otherwise(0.0),
            "amount_rank": 1 / F.row_number().over(src.orderBy(F.desc("amount"), "edge_id")),
            "time_rank": 1 / F.row_number().over(src.orderBy(late("ts"), late("block_number"), "edge_id")),
            "src_degree": F.log1p(F.count("*").over(src)),
            "dst_degree": F.log1p(F.count("*").over(dst)),
            "is_token": F.col("token_address").isNotNull().cast("int"),
            "is_loop": (F.col("src") == F.col("dst")).cast("int"),
        }
    )


def burst_rating(edges: DataFrame) -> DataFrame:
    """Share of a receiver's volume in a unit and 30-day month that falls within two days of a transfer, both ends included; self loops left out."""
    rows = edges.where("src != dst").withColumn("month", F.floor(F.col("ts") / (30 * DAY)))
    unit = Window.partitionBy("case_id", "dst", "asset", "month")
    near = F.sum("amount").over(unit.orderBy("ts").rangeBetween(-2 * DAY, 2 * DAY)).cast("double")
    return rows.withColumn("rating", near / F.sum("amount").over(unit).cast("double"))


def daily_spikes(edges: DataFrame) -> DataFrame:
    """By receiver, unit and day: volume, and its rise over the active day before as a share of the whole."""
    days = edges.groupBy("case_id", "dst", "asset", F.floor(F.col("ts") / DAY).alias("day")).agg(F.sum("amount").alias("volume"))
    unit = Window.partitionBy("case_id", "dst", "asset")
    rise = F.greatest(F.lit(0), F.col("volume") - F.coalesce(F.lag("volume").over(unit.orderBy("day")), F.lit(0)))
    return days.withColumn("spike", rise.cast("double") / F.sum("volume").over(unit).cast("double"))


def trailing(edges: DataFrame, spans: Sequence[int] = (21600, 172800)) -> DataFrame:
    """Counts and sums up to a transfer over all time and over trailing spans, by source and by receiver."""
    out = edges
    for end in ("src", "dst"):
        by = Window.partitionBy("case_id", end).orderBy("ts")
        for name, start in (("all", Window.unboundedPreceding), *((f"{s // 3600}h", -s) for s in spans)):
            w = by.rangeBetween(start, 0)
            out = out.withColumn(f"{end}_n_{name}", F.log1p(F.count("*").over(w))).withColumn(f"{end}_v_{name}", F.log1p(F.sum("amount").over(w).cast("double")))
    return out


def intervals(edges: DataFrame, end: str) -> DataFrame:
    """Gaps between a node's consecutive transfers: mean, least, most and deviation."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("case_id", end).orderBy("ts", "edge_id"))
    rows = edges.where("ts > 0").withColumn("gap", gap)
    return rows.groupBy("case_id", end).agg(F.avg("gap").alias("mean"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.stddev_pop("gap").alias("deviation"))


def temporal_encoding(edges: DataFrame, frequencies: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Time between a case's first and last transfer, from 0 to 1, with sines and cosines of its multiples of pi."""
    out = with_summary(edges, ["case_id"], __lo=F.min("ts"), __hi=F.max("ts"))
    lo, hi = F.col("__lo"), F.col("__hi")
    out = out.withColumn("t", F.when(hi > lo, (F.col("ts") - lo) / (hi - lo)).otherwise(0.0)).drop("__lo", "__hi")
    return out.withColumns({f"{n}{f}": fn(F.col("t") * f * F.pi()) for f in frequencies for n, fn in (("sin", F.sin), ("cos", F.cos))})


def propagate(features: DataFrame, weights: DataFrame, columns: Sequence[str], steps: int = 1) -> DataFrame:
    """X' = W X, several times: each edge takes the weighted sum of its neighbours' features."""
    out = features.select("case_id", "edge_id", *columns)
    for _ in range(steps):
        near = weights.join(out.withColumnRenamed("edge_id", "e2"), ["case_id", "e2"])
        out = near.groupBy("case_id", F.col("e1").alias("edge_id")).agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns))
    return out


def spread(edges: DataFrame, columns: Sequence[str], steps: int = 1) -> DataFrame:
    """What ``propagate`` over ``evidence.line_graph`` gives, without the line graph: case_id, edge_id and the columns.

    An edge's neighbours are the edges at its source and at its receiver; those at both, between the same two nodes, would
    count twice. So sums over neighbours are sums by node less sums by pair: work grows with the edges, at a hub too.
    """

    def sums(rows: DataFrame, of: dict) -> DataFrame:
        loop = F.col("src") == F.col("dst")
        named = {k: f"__{k}" for k in of}
        by_node = rows.select("case_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), *(c.alias(k) for k, c in of.items())).groupBy("case_id", "node").agg(*(F.sum(k).alias(k) for k in of))
        low, high = F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")
        by_pair = rows.where(~loop).select("case_id", low, high, *(c.alias(k) for k, c in of.items())).groupBy("case_id", "low", "high").agg(*(F.sum(k).alias(f"{n}_pair") for k, n in named.items()))
        out = rows.withColumns({"low": F.when(~loop, F.least("src", "dst")), "high": F.when(~loop, F.greatest("src", "dst"))})
        for end in ("src", "dst"):
            out = out.join(by_node.select("case_id", F.col("node").alias(end), *(F.col(k).alias(f"{n}_{end}") for k, n in named.items())), ["case_id", end])
        out = out.join(by_pair, ["case_id", "low", "high"], "left")
        total = lambda n: F.when(loop, F.col(f"{n}_src")).otherwise(F.col(f"{n}_src") + F.col(f"{n}_dst") - F.col(f"{n}_pair"))
        return out.select(*rows.columns, *(total(n).alias(n) for n in named.values()))

    rows = sums(edges.select("case_id", "edge_id", "src", "dst", *columns), {"k": F.lit(1)}).withColumnRenamed("__k", "degree")
    for _ in range(steps):
        summed = sums(rows, {c: F.col(c) / F.sqrt("degree") for c in columns})
        rows = summed.select("case_id", "edge_id", "src", "dst", "degree", *((F.col(f"__{c}") / F.sqrt("degree")).alias(c) for c in columns))
    return rows.select("case_id", "edge_id", *columns)


def read_out(features: DataFrame, columns: Sequence[str], fn=F.max) -> DataFrame:
    """Features with a summary over the case beside them."""
    return with_summary(features, ["case_id"], **{f"case_{c}": fn(c) for c in columns})


def read_out_top(features: DataFrame, columns: Sequence[str], n: int = 3) -> DataFrame:
    """Features with the mean of the n greatest values of each column over the case beside them (top_...)."""
    long = features.select("case_id", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("v")).select("case_id", "v.*")
    top = top_n_per_group(long, ["case_id", "name"], [F.desc("value")], n).groupBy("case_id", "name").agg(F.avg("value").alias("mean"))
    wide = top.groupBy("case_id").agg(*(F.max(F.when(F.col("name") == c, F.col("mean"))).alias(f"top_{c}") for c in columns))
    return features.join(wide, "case_id")


def role_fusion(edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of features over the case, over the source's and over the receiver's transfers."""
    out = edges
    for name, keys in (("case", ["case_id"]), ("src", ["case_id", "src"]), ("dst", ["case_id", "dst"])):
        means = edges.groupBy(*keys).agg(*(F.avg(c).alias(f"{name}_{c}") for c in columns))
        out = out.join(means, keys)
    return out


def prototypes(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the root mean square distance to each class's mean, negated, as a map from class to distance."""
    means = rows.groupBy(F.col(label).alias("class")).agg(*(F.avg(c).alias(f"m_{c}") for c in columns))
    # One row a class.
    squares = sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in columns[1:]), (F.col(columns[0]) - F.col(f"m_{columns[0]}")) ** 2)
    return rows.join(F.broadcast(means)).withColumn("distance", -F.sqrt(squares / len(columns)))


def ranked_metrics(predictions: DataFrame, keys: Sequence[str], p: str, gold: str, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """By key: reciprocal rank of the first correct prediction (null without one) and hits among the first k."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(p), "edge_id"))
    rows = predictions.withColumn("rank", rank)
    best = F.min(F.when(F.col(gold), F.col("rank")))
    return rows.groupBy(*keys).agg((1 / best).alias("mrr"), *(F.coalesce(best <= k, F.lit(False)).alias(f"hit_{k}") for k in ks))

