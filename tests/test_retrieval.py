"""Pruned retrieval and matches by reason against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evidence, retrieval

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
TOKENS = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")


def plain(docs, items, k):
    bags = {i: Counter((t or "").split()) for i, t in docs}
    df = Counter(w for b in bags.values() for w in b)
    n, out = len(docs), []
    for item, text in items:
        asked = Counter((text or "").split())
        rows = []
        for i, b in bags.items():
            both = [w for w in asked if w in b]
            if both:
                s = sum((1 + math.log(b[w])) * (1 + math.log(asked[w])) * max(math.log((n + 1) / (df[w] + 0.5)), 0.1) for w in both)
                rows.append((-round(s, 4), i))
        out += [(item, i, -s) for s, i in sorted(rows)[:k]]
    return sorted(out)


def made(seed, n, m, rarer=400):
    rng = random.Random(seed)
    rare = [f"r{i}" for i in range(rarer)]
    docs = [(i, " ".join(rng.choices(["the", "of", "a"], k=rng.randint(1, 30)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(n)]
    items = [(i, " ".join(["the", "of", *rng.choices(rare, k=3)])) for i in range(m)]
    return docs, items


@pytest.mark.parametrize("seed,block,k", [(1, 8, 10), (2, 64, 3), (3, 1, 1)])
def test_retrieval(spark, seed, block, k):
    docs, items = made(seed, 500, 12)
    docs += [(900, None), (901, "")]
    items += [(50, None), (51, "nowhere"), (52, "the the of")]
    got = retrieval.tfidf(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), k, TOKENS, block)
    found = sorted((r.item_id, r.doc_id, r.score) for r in got.collect())
    want = plain(docs, items, k)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=2e-4)


def test_a_common_word_is_mostly_skipped(spark):
    docs, items = made(4, 4000, 10, rarer=4000)
    index = retrieval.block_index(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), TOKENS, 16)
    first, _, rest = retrieval.bounded_blocks(index, 3)
    read = first.select("item_id", "block").unionByName(rest).join(index.postings.where("tok = 'the'"), "block").count()
    every = index.postings.where("tok = 'the'").count() * len(items)
    assert every > 30_000 and read < 0.25 * every


def test_no_documents(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b")], ITEM)
    assert retrieval.tfidf(docs, items, 3, TOKENS).count() == 0
    assert retrieval.tfidf(spark.createDataFrame([(1, "a")], DOC), items.limit(0), 3, TOKENS).count() == 0


def test_reasoned_matches(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "d", None]
    edge = lambda i: ("case_1", f"e{i}", rng.choice(names), rng.choice(names), rng.choice(["A", "N", None]), rng.choice([0.0, 1.0, 100.0, 100.5, 101.0, 1000.0]), i)
    schema = "case_id string, edge_id string, src string, dst string, asset string, amount double, ts long"
    money = lambda df: df.withColumn("amount", F.col("amount").cast("decimal(18,4)"))
    reported = money(spark.createDataFrame([edge(i) for i in range(60)], schema)).withColumnRenamed("edge_id", "reported_id").drop("ts")
    transfers = money(spark.createDataFrame([edge(i) for i in range(80)], schema))
    every = evidence.match_transactions(reported, transfers)
    rows = lambda df: sorted((r.reported_id, r.tx_edge, tuple(r.reasons)) for r in df.collect())
    assert rows(evidence.reasoned_matches(reported, transfers)) == rows(every.where(F.size("reasons") > 0))
    assert every.where(F.size("reasons") == 0).count() > 0


def test_nearest_by_common_and_rare_tokens(spark):
    """Keys that share the most tokens, by common sets, rare tokens and both, against brute force; no common token is joined by pairs."""
    import random

    from ledgerloom.plans.texts import nearest_by_tokens

    rng = random.Random(4)
    bags = {k: {"all"} | {f"c{rng.randrange(4)}{j}" for j in range(rng.randrange(9))} | {f"r{rng.randrange(60)}" for _ in range(rng.randrange(3))} for k in range(120)}
    bags[120], bags[121] = {"all", "alone"}, {"all"} | {f"c{i}{j}" for i in range(4) for j in range(8)}
    rows = spark.createDataFrame([(k, t) for k, b in bags.items() for t in b], "k int, tok string")
    want = {k: min((-len(b & o), j) for j, o in bags.items() if j != k) for k, b in bags.items()}
    for common, widest in ((5, 10), (5, 3), (1, 6), (1000, 10)):
        got = nearest_by_tokens(rows, "k", common, widest).collect()
        assert {r.k: (-r.shared, r.nearest) for r in got} == want and len(got) == len(bags)


def test_nearest_with_a_token_of_most_keys(spark):
    """20,000 keys of which two in three hold a token: pairs would be 178 million."""
    from pyspark.sql import functions as F

    from ledgerloom.plans.texts import nearest_by_tokens

    rows = spark.range(20000).select("id", F.explode(F.array(F.when(F.col("id") % 3 > 0, "most"), F.concat(F.lit("own"), F.floor(F.col("id") / 2)))).alias("tok")).where("tok is not null")
    got = nearest_by_tokens(rows, "id").collect()
    most = lambda i: i % 3 > 0
    want = {i: (i ^ 1, 1 + (most(i) and most(i ^ 1))) if most(i ^ 1) or not most(i) else (1, 1) for i in range(5, 20000)}
    assert len(got) == 20000 and {r.id: (r.nearest, r.shared) for r in got if r.id >= 5} == want
