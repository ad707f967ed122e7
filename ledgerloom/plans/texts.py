"""Queries of text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..operators import retrieval
from ..operators.relational import kept, top_n_per_group
from ..registry import query
from ..views import Tables

_TOKENS = "list_filter(regexp_extract_all(lower(text), '0x[0-9a-f]+|[a-z0-9_:-]{2,}'), lambda x: x <> '')"


@query(
    "tfidf_topk",
    f"""WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS tok FROM documents), tf AS (SELECT doc_id, tok, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok), n AS (SELECT count(*) AS n FROM documents),
 q AS (SELECT item_id, tok, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS tok FROM benchmark) x GROUP BY ALL),
 s AS (SELECT item_id, doc_id, round(sum((1 + ln(tf)) * (1 + ln(qtf)) * greatest(ln((n + 1) / (df + 0.5)), 0.1)), 4) AS score FROM q JOIN tf USING (tok) JOIN df USING (tok), n GROUP BY ALL)
 SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s) x WHERE rn <= 10""",
)
def tfidf_topk(t: Tables) -> DataFrame:
    return retrieval.tfidf(t.documents.select("doc_id", "text"), t.benchmark, 10, tokens)


@query(
    "nearest_task",
    f"""WITH d AS (SELECT DISTINCT page_id, unnest(list_filter(regexp_extract_all(lower(url), '0x[0-9a-f]+|[a-z0-9_:-]{{2,}}'), lambda x: x <> '')) AS tok FROM pages), p AS (SELECT a.page_id, b.page_id AS nearest, count(*) AS shared FROM d a JOIN d b ON a.tok = b.tok AND a.page_id <> b.page_id GROUP BY ALL) SELECT page_id, nearest, shared FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY shared DESC, nearest) AS rn FROM p) x WHERE rn = 1""",
)
def nearest_task(t: Tables) -> DataFrame:
    return nearest_by_tokens(t.pages.select("page_id", F.explode(F.array_distinct(tokens("url"))).alias("tok")), "page_id")


#: A token of more keys than this counts by sets of such tokens, not by pairs of keys.
COMMON = 256
#: So many common tokens of a key are counted by their subsets; where a key has more, the least common of them all are joined.
WIDEST = 10


def nearest_by_tokens(bag: DataFrame, key: str, common: int = COMMON, widest: int = WIDEST) -> DataFrame:
    """For each key of a bag (key, tok; no repeats) the other one that shares the most tokens, the first by key among equals.

    Tokens that all keys hold add the same to every pair: they are counted. Keys that share a rare token are joined, so
    pairs grow with the keys. Common tokens are not: keys with the same set of them are one, and a set meets others by
    its subsets, as what two sets share is the greatest subset of both. A pair that shares rare tokens too is found with
    less by its subset, and with all it shares by the join.
    """
    bag = kept(bag)
    sizes = bag.groupBy("tok").agg(F.count("*").alias("df"))
    n = bag.select(key).distinct().agg(F.count("*").alias("n"))
    marked = kept(sizes.join(F.broadcast(n)).withColumn("everywhere", F.col("df") == F.col("n")))
    everywhere = marked.where("everywhere").agg(F.count("*").alias("common"))
    often = marked.where(f"not everywhere and df > {common}").select("tok", F.struct("df", "tok").alias("t"))
    sets = bag.join(often, "tok").groupBy(key).agg(F.sort_array(F.collect_list("t"), False).alias("c"))
    # Tokens up to the most common one that comes after the widest set of a key are joined as rare ones are.
    bound = sets.agg(F.max(F.get("c", F.lit(widest))).alias("bound"))
    sets = sets.join(F.broadcast(bound)).select(key, F.transform(F.filter("c", lambda x: F.col("bound").isNull() | (x > F.col("bound"))), lambda x: x["tok"]).alias("c"))
    sets = kept(bag.select(key).distinct().join(sets, key, "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>"))))
    best = found_by_sets(sets, key).unionByName(found_by_rare_tokens(bag, marked, often, bound, sets, key))
    best = top_n_per_group(best, [key], [F.desc("shared"), F.col("nearest")], 1)
    return best.join(F.broadcast(everywhere)).withColumn("shared", F.col("shared") + F.col("common")).drop("common").where("shared > 0")


def found_by_sets(sets: DataFrame, key: str) -> DataFrame:
    """For each key (key, c: sorted tokens) the other one whose set shares the most with its own, the first by key."""
    # Two keys stand for all of a set, as for all whose sets hold a subset: a key's nearest is the first that is not itself.
    two = top_n_per_group(sets.select("c", F.col(key).alias("nearest")), ["c"], [F.col("nearest")], 2)
    masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("c")) - 1)
    parts = F.transform(masks, lambda m: F.filter("c", lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    by_part = lambda df: df.withColumn("part", F.explode(parts))
    holders = kept(top_n_per_group(by_part(two).select("part", "nearest"), ["part"], [F.col("nearest")], 2))
    met = by_part(sets.select("c").distinct()).join(holders, "part").groupBy("c", "nearest").agg(F.max(F.size("part")).cast("long").alias("shared"))
    ranked = top_n_per_group(met, ["c"], [F.desc("shared"), F.col("nearest")], 2)
    return sets.join(ranked, "c").where(F.col(key) != F.col("nearest")).select(key, "nearest", "shared")


def found_by_rare_tokens(bag: DataFrame, marked: DataFrame, often: DataFrame, bound: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Pairs of keys that share a token outside their sets, with all that they share."""
    counted = often.join(F.broadcast(bound)).where("bound is null or t > bound").select("tok")
    rare = marked.where("not everywhere and df > 1").select("tok").join(counted, "tok", "left_anti")
    rest = kept(bag.join(rare, "tok").join(sets, key))
    other = rest.select("tok", F.col(key).alias("nearest"), F.col("c").alias("d"))
    both = rest.join(other, "tok").where(F.col(key) != F.col("nearest"))
    return both.groupBy(key, "nearest").agg((F.count("*") + F.max(F.size(F.array_intersect("c", "d")))).alias("shared"))
