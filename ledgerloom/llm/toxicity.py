"""Toxicity by learning from confirmed toxic examples and unlabelled text.

A linear model over the presence of words is trained in numpy with the non-negative risk for positive and
unlabelled data: ``prior * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - prior * E_P[l(g, -1)])``, where ``prior``
is the share of toxic rows. No row is used as a confirmed clean example. Where the second part is
negative, the step goes the other way, which keeps the model from fitting the positives by heart.

The fit uses labelled rows alone: at most ``max_positives`` of those marked toxic, and at most ``max_unlabelled`` of
all of them, whose marks are then not looked at. Both are taken in the order of a hash of their keys; the bounds are
parameters. All words that tell the two apart by a test take part. Scores cover all rows and whole texts.

A null or empty text scores by the bias alone. With no positive rows, the prior is 0 and all scores are 0.
Rows of ``labels`` with a null key or label are not used; repeated rows are used once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_texts, checkpoint

MAX_POSITIVES = 4000
MAX_UNLABELLED = 12000

#: ASCII letters lower-cased; what is neither such a letter nor of a longer character parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").translate(_TABLE).split())


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: str | None) -> float:
        own = self.weights
        g = self.bias + sum(own[w] for w in own.keys() & words(text))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, g)))))


def fold(id_col: str):
    """crc32 of the key as text, modulo 3; rows of fold 1 are held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def fit_weights(rows: list[list[int]], positive: np.ndarray, n_words: int, prior: float, steps: int = 600, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Non-negative risk, logistic loss, Adam over the whole sample."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    w, b = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        g = np.bincount(at, w[col], len(rows)) + b
        s = sigmoid(g)
        soft = np.logaddexp(0, g)  # l(g, -1)
        negative = soft[u].sum() / n_u - prior * soft[p].sum() / n_p
        # derivatives by g: of l(g, +1) it is s - 1, of l(g, -1) it is s
        d = np.zeros(len(rows))
        if negative >= 0:
            d[p] = prior * (s[p] - 1) / n_p - prior * s[p] / n_p
            d[u] = s[u] / n_u
        else:
            d[p] = prior * s[p] / n_p
            d[u] = -s[u] / n_u
        grad = np.append(np.bincount(col, d[at], n_words) + l2 * prior * w, d.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows, in the order of a hash of the key."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, hold_out: bool = True) -> Model:
    """Fits a model; with ``hold_out``, rows of fold 1 take no part."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    if hold_out:
        known, keys = known.where(fold("doc_id") != 1), keys.where(fold("doc_id") != 1)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y").alias("share")).first()["share"]
    if not share:
        return Model({}, -30.0)
    prior = min(0.95, max(1e-4, float(share)))
    there = known.join(keys, "doc_id", "left_semi")
    pos = _sample(there.where("y = 1").select("doc_id"), max_positives)
    # Confirmed ones are among the unlabelled, too: the risk needs them to hold positives at the prior's rate.
    chosen = pos.withColumn("p", F.lit(True)).unionByName(_sample(there.select("doc_id"), max_unlabelled).withColumn("p", F.lit(False)))
    # Bounded by the two parameters, so it may be broadcast.
    texts = as_texts(docs, id_col, text_col).join(F.broadcast(checkpoint(chosen)), "doc_id")
    fields = [T.StructField("words", T.ArrayType(T.BinaryType()))]
    bags = checkpoint(append_columns(texts, ["text"], fields, lambda: lambda ts: [[sorted(words(t)) for t in ts]]).drop("text"))
    sizes = {r["p"]: r["n"] for r in bags.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))))
    # Words whose shares differ by three deviations; the sample bounds their number.
    stats = bags.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("p")).alias("a"), F.count_if(~F.col("p")).alias("b")).where("a + b >= 8")
    share_all = (F.col("a") + F.col("b")) / (n_p + n_u)
    z = F.abs(F.col("a") / n_p - F.col("b") / n_u) / F.sqrt(share_all * (1 - share_all) * (1 / n_p + 1 / n_u) + 1e-12)
    vocab = [bytes(r["word"]) for r in stats.withColumn("z", z).where("z >= 3").orderBy(F.desc("z"), "word").collect()]
    place = {w: i for i, w in enumerate(vocab)}
    fields = [T.StructField("has", T.ArrayType(T.IntegerType()))]
    rows = append_columns(bags, ["words"], fields, lambda: lambda ws: [[[place[w] for w in r if w in place] for r in ws]]).select("doc_id", "p", "has").orderBy("doc_id", "p").collect()
    w, b = fit_weights([list(r["has"]) for r in rows], np.array([r["p"] for r in rows]), len(vocab), prior)
    return Model(dict(zip(vocab, w.tolist())), b)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``out_col``."""
    fields = [T.StructField(out_col, T.DoubleType())]
    return append_columns(docs, [text_col], fields, lambda: lambda texts: [[model.score(t) for t in texts]])
