"""Boosted trees and a layered network against a plain tree search and on held-out rows; registries of detectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import boosting, detectors, layered


def test_first_split_is_the_best():
    """One tree of depth 1 against all cuts of all features tried by hand."""
    rng = np.random.default_rng(3)
    x, y = rng.random((300, 3)), None
    y = (x[:, 1] + 0.3 * rng.random(300) > 0.6).astype(float)
    w = np.ones(300)
    trees = boosting.grow(x, y, w, 1, 1, 1.0, bins=16)
    p = (y.sum() + 0.5) / 301
    g, h = p - y, np.full(300, p * (1 - p))
    gain = {}
    for j, cuts in enumerate(boosting.quantile_cuts(x, 16)):
        for k, c in enumerate(cuts):
            left = x[:, j] <= c
            gain[j, k] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
    assert (int(trees.feature[0, 0]), int(trees.above[0, 0])) == max(gain, key=gain.get)
    left = x[:, 1] <= trees.cuts[1][trees.above[0, 0]]
    want = trees.start + np.where(left, *(-g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)))
    assert trees.margins(x) == pytest.approx(want)


def test_loss_falls():
    rng = np.random.default_rng(4)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    loss = lambda t: np.logaddexp(0, -(2 * y - 1) * t.margins(x)).mean()
    a, b = (boosting.grow(x, y, np.ones(500), n, 3, 0.2) for n in (2, 60))
    assert loss(b) < 0.3 * loss(a) and ((b.margins(x) > 0) == y).mean() > 0.98


def made(spark, n):
    rng = np.random.default_rng(5)
    x = rng.random((n, 3))
    label = (2 * (x[:, 0] > 0.5) + (x[:, 1] > 0.4)).astype(int)
    rows = [(str(i), *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "edge_id string, a double, b double, c double, label int")


def test_classes_on_held_out_rows(spark):
    rows = made(spark, 1200)
    train = F.col("edge_id").cast("int") % 2 == 0
    models = boosting.fit_boosted(rows.where(train), ["a", "b", "c"], range(4), ["edge_id"], rounds=40, depth=3, rate=0.2)
    out = boosting.with_probabilities(rows.where(~train).withColumn("__p0", F.lit("mine")), models, ["a", "b", "c"])
    best = F.array_position(F.array(*(F.col(f"__p{i}") for i in range(4))), F.greatest(*(f"__p{i}" for i in range(4)))) - 1
    assert out.select(F.avg((best == F.col("label")).cast("double"))).first()[0] > 0.97
    # A bounded sample; the same rows whatever their partitions.
    one, two = (boosting.fit_boosted(df, ["a", "b"], [1], ["edge_id"], sample=100, rounds=3) for df in (rows, rows.repartition(7)))
    assert (one[1].leaf == two[1].leaf).all()


def test_network_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((30, 4)), rng.integers(0, 3, 30)
    net = layered.train(x, y, 3, hidden=5, epochs=1)
    v = net.inputs(x)

    def loss():
        z = np.maximum(v @ net.w1 + net.b1, 0) @ net.w2 + net.b2
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(30), y])) + 0.01 / 60 * float((net.w1**2).sum() + (net.w2**2).sum())

    for name, g in zip(("w1", "b1", "w2", "b2"), layered.gradients(net, v, y, 0.01)):
        a = getattr(net, name)
        at = np.unravel_index(np.argmax(np.abs(g)), a.shape)
        a[at] += 1e-5
        up = loss()
        a[at] -= 2e-5
        down = loss()
        a[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-3), name


def test_network_on_held_out_rows(spark):
    rows = made(spark, 1200)
    train = F.col("edge_id").cast("int") % 2 == 0
    net = layered.fit_network(rows.where(train), ["a", "b", "c"], 4, ["edge_id"], rate=0.01)
    names = [f"p{i}" for i in range(4)]
    out = layered.with_class_probabilities(rows.where(~train).withColumn("p0", F.lit("mine")), net, ["a", "b", "c"], names)
    best = F.array_position(F.array(*names), F.greatest(*names)) - 1
    assert out.select(F.avg((best == F.col("label")).cast("double"))).first()[0] > 0.95
    odd = spark.createDataFrame([("1", None, float("nan"), float("inf"), None)], rows.schema)
    assert sum(layered.with_class_probabilities(odd, net, ["a", "b", "c"], names).select(*names).first()) == pytest.approx(1)
    none = layered.fit_network(rows.where("false"), ["a", "b", "c"], 4, ["edge_id"])
    assert list(layered.with_class_probabilities(odd, none, ["a", "b", "c"], names).select(*names).first()) == [0.25] * 4


def test_odd_rows(spark):
    schema = "edge_id string, a double, label int"
    empty = spark.createDataFrame([], schema)
    models = boosting.fit_boosted(empty, ["a"], [0, 1], ["edge_id"], rounds=3)
    odd = spark.createDataFrame([("1", None, 1), ("2", float("nan"), 1), ("3", float("inf"), None), ("3", 1e300, 1)], schema)
    assert [r["__p0"] for r in boosting.with_probabilities(odd, models, ["a"]).collect()] == [0.5] * 4
    assert boosting.with_probabilities(empty, models, ["a"]).count() == 0
    models = boosting.fit_boosted(odd, ["a"], [0, 1], ["edge_id"], rounds=3)
    rows = boosting.with_probabilities(odd, models, ["a"]).collect()
    assert all(r["__p1"] > 0.75 and r["__p0"] < 0.25 for r in rows)


def test_registries(spark):
    rows = [("case_1", f"e{i}", s, d, a, 10 + i, "ETH") for i, (s, d, a) in enumerate([("a", "b", 9.0), ("b", "c", 5.0), ("b", "d", 1.0), ("e", "f", 3.0)])]
    edges = spark.createDataFrame(rows, "case_id string, edge_id string, src string, dst string, amount double, ts long, asset string").withColumn("amount", F.col("amount").cast("decimal(18,4)"))
    active = spark.createDataFrame([("case_1", "a")], "case_id string, node string")
    found = {r.edge_id: (r.active, r.action) for r in detectors.detect("rank_community", edges, active).collect()}
    assert found["e0"] == (True, "follow") and found["e1"][1] == "follow" and found["e3"] == (False, "ignore")
    nodes = {r.node: r.probability for r in detectors.detect_nodes("max_outflow", edges).collect()}
    assert nodes["a"] == 1.0 and nodes["b"] == pytest.approx(5 / 9)
    assert {r.node for r in detectors.detect_nodes("suspicious", edges).collect()} <= set("abcdef")
    with pytest.raises(ValueError, match="no node detector x"):
        detectors.detect_nodes("x", edges)
    with pytest.raises(ValueError, match="registered already"):
        detectors.node_detector("max_outflow")(lambda e: e)
