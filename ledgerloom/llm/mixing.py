"""Mixing a corpus to target weights by soft domain membership, in DataFrame functions alone.

1. A classifier learns domains from a table of labels: naive Bayes over hashed words, from at most
   ``max_labelled`` labelled rows, taken in the order of a hash of their keys (a parameter). Its tables have
   a fixed number of buckets. Posteriors are softened to the weight of ``strength`` words, so that long
   texts keep a share of doubt.
2. Each document gets a rate, from ``least_rate`` to ``most_rate``, such that expected tokens by domain (rate x tokens x
   posterior) meet the targets: least squares by projected gradient. All rates are updated in place, each from
   its own posteriors and the residuals; an iteration moves only the sums by domain. The squares are weighted
   by the inverse Gram matrix of the domains, for which a step of 1 is right. The sums that are reached are part of the
   result. Where the total is free and no total above zero can meet the weights, rates stay as they are, and the difference
   from the weights is the residual; with ``strict`` that is an error.
3. ``copies`` turns a rate into whole copies: its whole part, and one more where a hash of the key falls
   below the rest.

Documents without words have no tokens; their rate stays 1, or the nearest that is allowed. Rows with a null text count
as empty; tables without any token are met as they are, with a residual of 0. Labels with nulls are not used. Without labels
all posteriors are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, small, unused

DOMAINS = ("good", "poor", "toxic")
BUCKETS = 1024
MAX_LABELLED = 8000


def domain_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and domain of labelled rows: toxic, else by quality."""
    y = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(F.col(id_col).cast("long").alias("doc_id"), y.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))


def word_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Hashed words of a text, as places from 1."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int") + 1)


def fit_domains(docs: DataFrame, domains: DataFrame, names: tuple[str, ...], text_col: str, max_labelled: int, buckets: int = BUCKETS) -> tuple[list[float], list[list[float]]]:
    """Log priors and, by domain, the log likelihoods of the buckets."""
    chosen = checkpoint(domains.where(F.col("domain").isin(*names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # Bounded by max_labelled, so it may be broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    counts = rows.select("domain", F.explode(word_buckets(F.col("text"), buckets)).alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()
    seen = np.ones((len(names), buckets))
    for r in counts:
        seen[names.index(r["domain"]), r["bucket"] - 1] += r["n"]
    n = np.ones(len(names))
    for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect():
        n[names.index(r["domain"])] += r["n"]
    return np.log(n / n.sum()).tolist(), np.log(seen / seen.sum(1, keepdims=True)).tolist()


def _sum_of(places: str, values: np.ndarray) -> Column:
    table = F.array(*(F.lit(float(x)) for x in values))
    return F.aggregate(places, F.lit(0.0), lambda a, b: a + F.get(table, b - 1))


def posteriors(docs: DataFrame, log_prior: list[float], log_like: list[list[float]], text_col: str, strength: float = 16.0) -> DataFrame:
    """``docs`` columns but the text, with n_tokens and p (array of posteriors)."""
    keep = [c for c in docs.columns if c not in (text_col, "n_tokens", "p", "buckets")]
    out = docs.select(*keep, word_buckets(F.col(text_col), len(log_like[0])).alias("buckets"))
    base = np.array(log_like[0])
    # Only differences from the first domain matter.
    sums = [F.lit(0.0)]
    for like in log_like[1:]:
        sums.append(_sum_of("buckets", np.array(like) - base))
    n = F.size("buckets")
    out = out.select(*keep, n.cast("long").alias("n_tokens"), F.array(*sums).alias("sums"))
    share = F.lit(strength) / F.greatest(F.lit(strength), F.col("n_tokens").cast("double"))
    logits = [F.lit(p) + F.col("sums")[k] * share for k, p in enumerate(log_prior)]
    out = out.select(*keep, "n_tokens", F.array(*logits).alias("logits"))
    top = F.array_max("logits")
    out = out.select(*keep, "n_tokens", F.transform("logits", lambda x: F.exp(x - top)).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return out.select(*keep, "n_tokens", F.transform("e", lambda x: x / total).alias("p"))


@dataclass
class Mix:
    rates: DataFrame  #: the rows given, with ``rate``
    reached: list[float]  #: sums by domain, as shares of all tokens there are
    target: list[float]

    @property
    def residual(self) -> float:
        return max((abs(r - t) for r, t in zip(self.reached, self.target)), default=0.0)


#: Steps that are worked out anew from the last table before rates are written again.
FOLDED = 6
#: Steps without a new least residual after which a fit ends.
STUCK = 8
#: A free total is this share of the greatest one that cells of like posteriors can meet.
OF_GREATEST = 0.99
#: Levels of a posterior by the number of domains, so that there are at most some thousands of cells.
LEVELS = {2: 4096, 3: 64, 4: 24, 5: 12}


def greatest_total(soft: DataFrame, a: list[Column], weights: list[float], least_rate: float, top: float) -> float:
    """About the greatest total at which ``weights`` can be met by rates between the bounds; 0 or less if there is none.

    Documents are summed by cells of like posteriors, at most some thousands, in one pass. The sums that rates reach are a
    convex set, so the total is the least value of its support function over all directions l with l . weights = 1: the
    rates that reach farthest are the greatest where l . a is positive and the least elsewhere.
    """
    k = len(weights)
    level = LEVELS.get(k, 4)
    cells = soft.groupBy(*(F.floor(F.col("p")[i] * level).alias(f"c{i}") for i in range(k - 1))).agg(*(F.sum(c).alias(f"s{i}") for i, c in enumerate(a)))
    sums = np.array([[r[f"s{i}"] or 0.0 for i in range(k)] for r in cells.collect()]).reshape(-1, k)
    w = np.array(weights)
    # Directions that keep l . weights: the null space of the weights.
    across = np.linalg.svd(w[None, :])[2][1:]

    def support(at: np.ndarray) -> float:
        along = sums @ (w / (w @ w) + at @ across)
        return float(np.maximum(along, 0).sum() * top + np.minimum(along, 0).sum() * least_rate)

    def least(at: np.ndarray, axis: int, reach: float = 1e4) -> float:
        """Of the support function over the axes from ``axis`` on, by golden sections."""
        if axis == len(at):
            return support(at)
        value = lambda x: least(np.array([*at[:axis], x, *at[axis + 1 :]]), axis + 1)
        lo, hi, part = -reach, reach, 0.6180339887498949
        x, y = hi - part * (hi - lo), lo + part * (hi - lo)
        fx, fy = value(x), value(y)
        for _ in range(70):
            if fx < fy:
                hi, y, fy = y, x, fx
                x = hi - part * (hi - lo)
                fx = value(x)
            else:
                lo, x, fx = x, y, fy
                y = lo + part * (hi - lo)
                fy = value(y)
        return min(fx, fy)

    if k <= 3:
        return least(np.zeros(k - 1), 0)
    # More domains: lines in random directions through the best point so far.
    rng, at, best = np.random.default_rng(0), np.zeros(k - 1), support(np.zeros(k - 1))
    for n in range(400):
        d = rng.standard_normal(k - 1) * 0.98**n
        for x in np.linspace(-4, 4, 81):
            if (v := support(at + x * d)) < best:
                best, at = v, at + x * d
    return best


def fit_rates(soft: DataFrame, weights: list[float], least_rate: float = 0.0, most_rate: float | None = None, total: float | None = None, only_first_rises: bool = False, most_steps: int = 100, tolerance: float = 1e-6) -> Mix:
    """Rates for rows of n_tokens and p.

    ``total`` is the number of tokens aimed at, in times of those there are. None takes the least total of 1 or more
    for which ``weights`` can be met while every document keeps ``least_rate``; where ``most_rate`` is given, about the
    greatest total that can be met (see ``greatest_total``). With ``only_first_rises``, a domain but the first whose share is below its weight
    keeps its share, and the first takes up the rest.
    """
    k = len(weights)
    weights = [w / sum(weights) for w in weights]
    all_tokens = float(soft.agg(F.sum("n_tokens").cast("double").alias("n")).first()["n"] or 0.0) or 1.0
    a = [F.col("n_tokens") * F.col("p")[i] / F.lit(all_tokens) for i in range(k)]
    # Sums of squares are scaled, as a document is a tiny share of a large corpus.
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = soft.agg(*(F.sum(a[i]).alias(f"s{i}") for i in range(k)), *(F.sum(a[i] * a[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    there = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
    square = lambda row: np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    gram = square(row)
    top = float("inf") if most_rate is None else float(most_rate)
    start = min(top, max(1.0, least_rate))
    rated = soft.withColumn("rate", F.lit(start))
    if not gram.trace():
        return Mix(rated, (there * start).tolist(), (there * start).tolist())
    if only_first_rises:
        rest = [min(w, float(t)) for w, t in zip(weights[1:], there[1:] / there.sum())]
        weights = [1 - sum(rest), *rest]
    inverse = np.linalg.pinv(gram + np.eye(k) * 1e-12 * gram.trace())
    free_total, even = total is None, np.abs(there - np.array(weights) * there.sum()).max()
    if free_total and most_rate is None:
        total = max([1.0, *(least_rate * t / w for t, w in zip(there, weights) if w > 0)])
    elif free_total and even <= tolerance:
        total = start * there.sum()
    elif free_total:
        total = OF_GREATEST * greatest_total(soft, a, weights, least_rate, top)
        if total <= 1e-6:
            return Mix(rated, (there * start).tolist(), (np.array(weights) * there.sum() * start).tolist())
    target = np.array(weights) * total
    folded, reached, metric, written_rates = 0, there * start, inverse, []
    least, stuck = np.inf, 0
    for _ in range(most_steps):
        rest = reached - target
        worst = np.abs(rest).max()
        stuck = 0 if worst < 0.999 * least else stuck + 1
        least = min(least, worst)
        if worst <= tolerance * max(total, 1e-12) or (free_total and stuck >= STUCK):
            break
        step = metric @ rest
        moved = F.col("rate") - sum((F.lit(float(step[i])) * a[i] for i in range(1, k)), F.lit(float(step[0])) * a[0])
        moved = F.greatest(F.lit(float(least_rate)), moved)
        rated = rated.withColumn("rate", moved if most_rate is None else F.least(F.lit(top), moved))
        folded += 1
        if folded == FOLDED:
            folded, rated = 0, checkpoint(rated)
            written_rates.append(rated)
        # Rows that a bound holds do not move, so the metric of the next step leaves them out.
        free = F.when((F.col("rate") > float(least_rate)) & (F.col("rate") < F.lit(top)), 1.0).otherwise(0.0)
        row = rated.agg(*(F.sum(F.col("rate") * a[i]).alias(f"s{i}") for i in range(k)), *(F.sum(free * a[i] * a[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
        reached = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
        now, moving = np.abs(reached - target).max(), square(row)
        metric = np.linalg.pinv(moving + np.eye(k) * 1e-9 * moving.trace()) if now < worst and moving.trace() > 0 else inverse
    discard(*written_rates[:-1])
    return Mix(rated, reached.tolist(), target.tolist())


def copies(rate: Column, key: Column) -> Column:
    """Whole copies for a rate: equal keys get equal numbers."""
    part = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def fit_mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], least_rate: float = 0.0, total: float | None = 1.0, text_col: str = "text", max_labelled: int = MAX_LABELLED, strict: bool = False, **bounds) -> Mix:
    """Rates by row of ``docs`` (doc_id, n_tokens, p in the order of ``weights``, rate), and the sums that they reach."""
    names = tuple(weights)
    prior, like = fit_domains(docs, domain_of(labels), names, text_col, max_labelled)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    soft = checkpoint(posteriors(given, prior, like, "text"))
    made = fit_rates(soft, [weights[n] for n in names], least_rate, total=total, **bounds)
    if strict and made.residual > 0.01 * max(sum(made.target), 1e-12):
        raise ValueError(f"targets {made.target} cannot be met by these documents; reached {made.reached}")
    return made


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *args, **kwargs) -> DataFrame:
    """Per row of ``docs`` (with doc_id): doc_id, n_tokens, p (posteriors in the order of ``weights``), rate, n_copies and residual, the greatest difference from a target, in times of all tokens."""
    made = fit_mix(docs, labels, weights, *args, **kwargs)
    return made.rates.select("doc_id", "n_tokens", "p", "rate", copies(F.col("rate"), F.col("doc_id")).alias("n_copies"), F.lit(made.residual).alias("residual"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *args, **kwargs) -> DataFrame:
    """``docs`` with each row as often as its rate says. Rows of one key share the mean of their rates; null keys stay once."""
    made = mix(docs, labels, weights, *args, **kwargs).where("doc_id is not null").groupBy("doc_id").agg(F.avg("rate").alias("rate"))
    # Most rows stay once, so only the others are looked up.
    key, n = unused(docs, "key"), unused(docs, "n")
    other = small(made.select(F.col("doc_id").alias(key), copies(F.col("rate"), F.col("doc_id")).cast("int").alias(n)).where(F.col(n) != 1))
    out = docs.join(other, F.col("doc_id") == F.col(key), "left").withColumn(n, F.coalesce(n, F.lit(1)))
    return out.withColumn(unused(out, "copy"), F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*docs.columns)
