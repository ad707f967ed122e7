"""A network of one hidden layer of rectified units over standardised features, trained by Adam.

Like boosted trees it is fitted on a bounded sample, at most ``sample`` rows by a hash of their keys (a parameter); predictions
cover all rows. A feature that is null or no number counts as the sample's mean. A sample without rows gives equal
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import SAMPLE, sampled


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.where(np.isfinite(x), (x - self.mean) / self.scale, 0.0), -1e6, 1e6)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.inputs(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def gradients(net: Network, v: np.ndarray, y: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Of the mean cross entropy and the penalty over weights, for standardised rows v and marks y."""
    h = np.maximum(v @ net.w1 + net.b1, 0)
    z = h @ net.w2 + net.b2
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ net.w2.T) * (h > 0)
    share = penalty / len(y)
    return [v.T @ back + share * net.w1, back.sum(0), h.T @ p + share * net.w2, p.sum(0)]


def train(x: np.ndarray, y: np.ndarray, classes: int, hidden: int = 50, epochs: int = 200, rate: float = 1e-3, batch: int = 200, penalty: float = 1e-4, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    x = np.where(np.isfinite(x), x, np.nan)
    there = np.isfinite(x)
    n = np.maximum(1, there.sum(0))
    mean = np.where(there, x, 0).sum(0) / n
    scale = np.sqrt(np.where(there, (x - mean) ** 2, 0).sum(0) / n)
    scale[scale == 0] = 1
    bound = lambda a, b: np.sqrt(6 / (a + b))
    d = x.shape[1]
    net = Network(mean, scale, rng.uniform(-bound(d, hidden), bound(d, hidden), (d, hidden)), np.zeros(hidden), rng.uniform(-bound(hidden, classes), bound(hidden, classes), (hidden, classes)), np.zeros(classes))
    if not len(x):
        net.w2[:] = 0
        return net
    v, names, t = net.inputs(x), ("w1", "b1", "w2", "b2"), 0
    m, s = [np.zeros_like(getattr(net, k)) for k in names], [np.zeros_like(getattr(net, k)) for k in names]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            part = order[at : at + batch]
            t += 1
            for i, g in enumerate(gradients(net, v[part], y[part], penalty)):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                getattr(net, names[i])[...] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return net


def _matrix(columns: Sequence[pa.Array]) -> np.ndarray:
    return np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)


def fit_network(rows: DataFrame, columns: Sequence[str], classes: int, key: Sequence[str], label: str = "label", sample: int = SAMPLE, **sizes) -> Network:
    """A network for marks 0, 1, ...; the sample is bounded, so one task's worth of rows comes to where it is trained."""
    t = sampled(rows, columns, key, label, sample).toArrow().combine_chunks()
    x = _matrix([t.column(f"x{i}").combine_chunks() if t.num_rows else pa.array([], pa.float64()) for i in range(len(columns))])
    return train(x, t.column("y").to_numpy().astype(int), classes, **sizes)


def with_class_probabilities(rows: DataFrame, net: Network, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows with the probabilities of the classes in columns ``names``."""
    sent, kept, names, columns = rows.sparkSession.sparkContext.broadcast(net), [c for c in rows.columns if c not in names], list(names), list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.probabilities(_matrix([batch.column(batch.schema.get_field_index(c)) for c in columns]))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array(p[:, i]) for i in range(len(names)))], names=kept + names)

    schema = rows.select(*kept).schema
    for n in names:
        schema = schema.add(n, "double")
    return rows.select(*kept).mapInArrow(run, schema)
