"""The pipeline's stages, and mixing with a free total, on empty, null, unlabelled and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(rng.randint(5, 40))) for _ in range(n)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


SOME = corpus(1, 40)
CASES = {
    "no documents": ([], [(1, 1, 0)]),
    "only null and empty texts": ([(1, None, None, None, None), (2, "", "", "", 0), (3, " \t\n", "en", "s", 3)], [(1, 1, 0), (2, 0, 0)]),
    "no labels": (SOME, []),
    "null labels": (SOME, [(None, None, None), (1, None, None), (None, 1, 1)]),
    "all of one domain": (SOME, [(i, 1, 0) for i in range(40)]),
    "repeated rows and null keys": (SOME + SOME[:5] + [(None, SOME[0][1], None, None, 3), (None, None, None, None, None)], [(i, i % 2, 0) for i in range(40)] * 2),
}


@pytest.mark.parametrize("name", CASES)
def test_stages_and_run(spark, tmp_path, name):
    docs, labels = CASES[name]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, given, str(tmp_path))
        assert out.columns == given.columns and out.count() <= len(docs), stage
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r.doc_id for r in last if r.doc_id is not None))
    if name == "repeated rows and null keys":
        # The null key's copy of document 0 goes or stays with its group, as near-duplicates decides; no key comes twice.
        assert len(ids) == len(set(ids)) and set(ids) <= set(range(40)) and len(ids) > 20
    else:
        assert ids == sorted(d[0] for d in docs)


def test_stages_keep_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame(SOME, DOCS)
    for c in ("p", "rate", "n", "copy", "key", "n_tokens", "score", "found", "component_id", "kept", "__toxicity"):
        docs = docs.withColumn(c, F.lit("mine"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for stage, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        if stage != "toxicity":
            assert out.columns == docs.columns and {r.p for r in out.collect()} <= {"mine"}, stage


@pytest.mark.parametrize("labels,texts", [(0, 1), (1, 0), (1, 1)])
def test_actions_are_few(spark, monkeypatch, labels, texts):
    """However hard the weights, a fit takes about as many passes as steps of one total."""
    rows = [(i, t if texts else None) for i, t, *_ in SOME]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(40 * labels)], LABELS)
    passes = []
    first = type(docs).first
    monkeypatch.setattr(type(docs), "first", lambda self: passes.append(1) or first(self))
    made = mixing.fit_mix(docs, marks, {"good": 0.95, "poor": 0.05}, total=None, most_rate=1.0)
    assert len(passes) <= 25 and made.rates.count() == 40


def test_weights_that_cannot_be_met_keep_all(spark):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in SOME], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    made = mixing.fit_mix(docs, none, {"good": 0.9, "poor": 0.1}, total=None, most_rate=1.0)
    assert {r.rate for r in made.rates.collect()} == {1.0} and made.residual == pytest.approx(0.4)
    with pytest.raises(ValueError, match="cannot be met"):
        mixing.fit_mix(docs, none, {"good": 0.9, "poor": 0.1}, total=None, most_rate=1.0, strict=True)
    same = mixing.fit_mix(docs, none, {"good": 0.5, "poor": 0.5}, total=None, most_rate=1.0)
    assert {r.rate for r in same.rates.collect()} == {1.0} and same.residual < 1e-9
    empty = mixing.fit_mix(docs.where("false"), none, {"good": 0.9, "poor": 0.1}, total=None, most_rate=1.0, strict=True)
    assert empty.rates.count() == 0 and empty.residual == 0


@pytest.mark.parametrize("seed,weights", [(1, [0.7, 0.3]), (2, [0.2, 0.8]), (3, [0.5, 0.3, 0.2]), (4, [0.1, 0.1, 0.8])])
def test_greatest_total_is_the_linear_programme(spark, seed, weights):
    """Against the dual over a fine set of directions, and a greedy primal for two domains."""
    rng = random.Random(seed)
    k = len(weights)
    rows = []
    for _ in range(400):
        p = [rng.random() ** 2 for _ in range(k)]
        rows.append((rng.randint(1, 50), [x / sum(p) for x in p]))
    all_ = sum(n for n, _ in rows)
    soft = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    a = [F.col("n_tokens") * F.col("p")[i] / F.lit(float(all_)) for i in range(k)]
    got = mixing.greatest_total(soft, a, weights, 0.0, 1.0)
    made = mixing.fit_rates(soft, weights, total=got * 0.995, most_rate=1.0, most_steps=100)
    assert made.residual < 1e-3
    beyond = mixing.fit_rates(soft, weights, total=got * 1.02, most_rate=1.0, most_steps=60)
    assert beyond.residual > 1e-3 * got
    if k == 2:
        # Leave out what has most of the surplus domain until shares fit.
        good, bad = (sum(n * p[i] for n, p in rows) / all_ for i in range(2))
        extra = 0 if good / bad > weights[0] / weights[1] else 1
        left = sorted(rows, key=lambda r: -r[1][extra])
        s = [good, bad]
        while s[extra] / sum(s) > weights[extra]:
            n, p = left.pop(0)
            s = [x - n * y / all_ for x, y in zip(s, p)]
        assert got == pytest.approx(sum(s), abs=0.01)
