"""Exact retrieval by weighted shared tokens over a block-max index.

Documents are dealt into blocks by a hash of their ids. The index has the greatest impact of a token in a block, so a sum over
a query's tokens bounds from above what any document of the block can score. The blocks with the greatest bounds are scored
first and give each query a floor, its k-th best score there; then only blocks whose bound reaches the floor are scored.
Postings are joined by token and block: those of a common token are read where some query still needs them, and lie in as
many partitions as there are blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import dropped, kept, top_n_per_group

#: Documents of a block, about.
BLOCK = 64
#: Blocks of a query that are scored first, beside one for each of the k documents that are sought.
FIRST = 2
#: Scores are rounded to so many places before they are ranked.
PLACES = 4


@dataclass
class Index:
    postings: DataFrame  #: tok, block, doc_id, impact
    blocks: DataFrame  #: tok, block, most
    weights: DataFrame  #: item_id, tok, w

    def drop(self) -> None:
        dropped(self.postings, self.blocks, self.weights)


def block_index(docs: DataFrame, queries: DataFrame, tokens: Callable[[str], Column], block: int = BLOCK) -> Index:
    """Postings of the tokens that a query has, their greatest impacts by block, and the queries' weights.

    ``tokens`` makes the tokens of a column. A token's impact in a document is 1 + ln tf; its weight in a query is (1 + ln qtf) x the greater of ln((n + 1) / (df +
    0.5)) and 0.1, with n and df over all documents.
    """
    asked = queries.select("item_id", F.explode(tokens("text")).alias("tok")).groupBy("item_id", "tok").agg(F.count("*").alias("qtf"))
    asked = kept(asked)
    n = docs.agg(F.count("*").alias("n"))
    number = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
    tf = docs.select("doc_id", F.explode(tokens("text")).alias("tok")).join(asked.select("tok").distinct(), "tok", "left_semi").groupBy("doc_id", "tok").agg(F.count("*").alias("tf"))
    # One row of totals.
    placed = tf.join(F.broadcast(n)).select("tok", F.pmod(F.xxhash64("doc_id"), number).alias("block"), "doc_id", (1 + F.log("tf")).alias("impact"))
    postings = kept(placed)
    blocks = kept(postings.groupBy("tok", "block").agg(F.max("impact").alias("most"), F.count("*").alias("df")))
    df = blocks.groupBy("tok").agg(F.sum("df").alias("df"))
    weight = (1 + F.log("qtf")) * F.greatest(F.log((F.col("n") + 1) / (F.col("df") + 0.5)), F.lit(0.1))
    weights = kept(asked.join(df, "tok").join(F.broadcast(n)).select("item_id", "tok", weight.alias("w")))
    dropped(asked)
    return Index(postings, blocks, weights)


def scored(index: Index, chosen: DataFrame) -> DataFrame:
    """item_id, doc_id, score of the documents in the chosen blocks (item_id, block)."""
    pairs = chosen.select("item_id", "block").join(index.weights, "item_id").join(index.postings, ["tok", "block"])
    return pairs.groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("impact") * F.col("w")), PLACES).alias("score"))


def bounded_blocks(index: Index, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the blocks to score first (item_id, block), their scores, and the other blocks that may have one of the k best."""
    bounds = kept(index.blocks.join(index.weights, "tok").groupBy("item_id", "block").agg(F.sum(F.col("most") * F.col("w")).alias("bound")))
    first = kept(top_n_per_group(bounds, ["item_id"], [F.desc("bound"), F.col("block")], k + FIRST))
    found = kept(scored(index, first))
    best = top_n_per_group(found, ["item_id"], [F.desc("score"), F.col("doc_id")], k, rank="place")
    floors = best.where(F.col("place") == k).select("item_id", F.col("score").alias("floor"))
    others = bounds.join(first.select("item_id", "block"), ["item_id", "block"], "left_anti").join(floors, "item_id", "left")
    # Rounding may lift a score by half a unit of the last place.
    rest = kept(others.where(F.col("floor").isNull() | (F.col("bound") + 10.0**-PLACES >= F.col("floor"))).select("item_id", "block"))
    dropped(bounds)
    return first, found, rest


def tfidf(docs: DataFrame, queries: DataFrame, k: int, tokens: Callable[[str], Column], block: int = BLOCK) -> DataFrame:
    """Best k documents of each query: item_id, doc_id, score; equal scores go by the smaller id.

    Documents that share no token are not found. Null texts have no tokens, and their documents count in n.
    """
    index = block_index(docs, queries, tokens, block)
    first, found, rest = bounded_blocks(index, k)
    out = kept(top_n_per_group(found.unionByName(scored(index, rest)), ["item_id"], [F.desc("score"), F.col("doc_id")], k))
    index.drop()
    dropped(first, found, rest)
    return out
