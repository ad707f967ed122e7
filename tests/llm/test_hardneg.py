"""Hard negatives against brute force: odd rows, ties, huge and ragged vectors, pieces."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(v: float) -> int:
    return int(v) * 256 if abs(v) > 1 << 53 else math.floor(v * 256.0)


def brute(rows, every=100, positives=5, negatives=10):
    part = set()
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        part.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(whole(v) for v in x)))
    score = lambda a, b: sum(p * q for p, q in zip(a[2], b[2]))
    out = []
    for a in (r for r in part if r[0] % every == 0):
        near = sorted(((-score(a, r), r[0]) for r in part if r[1] == a[1] and r[0] != a[0]))[:positives]
        for minus, i in near:
            far = sorted((-score(a, r), r[0]) for r in part if r[1] != a[1] and 30 * -minus <= 100 * score(a, r) <= 90 * -minus)
            out += [(a[0], i, k + 1, j, -minus, -s) for k, (s, j) in enumerate(far[:negatives])]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, **more).collect())


def test_fields_do_not_carry():
    rng = np.random.default_rng(1)
    for bits in (3, 12, 27, 29, 40):
        x = rng.integers(-(1 << bits), 1 << bits, (50, 7))
        x[0], x[1] = (1 << bits) - 1, -(1 << bits)
        packed = hardneg.Packed(x if bits < 30 else x.astype(object), (1 << bits) + 1)
        for a in x[:5].tolist():
            assert packed.scores(a).tolist() == [sum(p * q for p, q in zip(a, r)) for r in x.tolist()]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.4) + (0.6 if k == i % 3 else 0) for k in range(8)], i % 3) for i in range(900)]
    rows += [(1000 + i, rows[i][1], (i * 7) % 4) for i in range(60)]  # equal scores
    rows += rows[100:130] + [(200, [0.5] * 8, 1)]  # repeated rows, and a row of its own with an id that is there
    rows += [(None, [1.0] * 8, 1), (2100, None, 1), (2200, [1.0, None] * 4, 1), (2300, [float("nan")] * 8, 2), (2400, [float("-inf")] * 8, 2), (2500, [1.0] * 8, None)]
    rows += [(2600, [], 1), (2700, [0.3] * 3, 2), (2800, [0.2] * 11, 0), (-300, [0.1] * 8, -1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("rank", "anchor_id", "score", "x", "piece", "near"):
        df = df.withColumn(c, F.lit("mine"))
    expected = brute(rows)
    assert len(expected) > 300
    assert found(df) == expected
    # Anchors in many pieces, several jobs of them.
    assert found(df.repartition(3), piece_bytes=1) == expected


@pytest.mark.parametrize("scale", [1e4, 1e9, 1e18])
def test_large_components(spark, scale):
    rng = random.Random(6)
    rows = [(i, [scale * (1 + rng.random()) for _ in range(3)], i % 2) for i in range(1, 60)] + [(100, [scale, scale / 2, scale], 0)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    fits = lambda s: s if -(1 << 63) <= s < 1 << 63 else None
    assert got and got == [(*r[:4], fits(r[4]), fits(r[5])) for r in brute(rows)]


def test_nothing_there(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []
    # All of one label: positives, but no negatives. Negative scores of positives: an empty range.
    assert found(spark.createDataFrame([(100, [1.0], 1), (101, [1.0], 1)], SCHEMA)) == []
    assert found(spark.createDataFrame([(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.5], 2)], SCHEMA)) == []
