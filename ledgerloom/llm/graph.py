"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard, hot_keys, salted_join

#: Links that one task may hold. Only larger tables have their keys counted, so that nodes with many links are split.
ONE_TASK = 1_000_000


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Per node of ``links`` (a, b), about ``rows`` if that is known: node and root, the smallest node that it reaches.

    Each step replaces the edges of a node by edges to its smallest neighbour, so the edges turn into
    stars in a number of rounds logarithmic in the longest path; rounds go on until nothing changes. Up to ``ONE_TASK``
    edges, smallest neighbours are minima over a window, a shuffle a step. Beyond that, a node with many edges is met by
    grouped minima and by joins that deal its edges over several tasks, never gathered. Nulls and self links are dropped.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct()
    edges, seen = _mark(edges, rows)
    while True:
        before, split = edges, seen[0] > ONE_TASK
        made = []

        def with_least(rows: DataFrame) -> DataFrame:
            """Edges of u with the smallest neighbour of u."""
            if not split:
                return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
            made.append(checkpoint(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))))
            return salted_join(rows, made[-1].select("u", "m"), "u", "v", hot_keys(made[-1], "u"))

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).withColumn("m", F.least("u", "m")).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Now edges go from a node to smaller ones; each of those is tied to the smallest.
        tied = with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges, now = _mark(tied.select("e.u", "e.v").where("u != v").distinct(), seen[0])
        discard(before, *made)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def _mark(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
    edges = checkpoint(edges, rows)
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return edges, (r["n"], r["x"])
