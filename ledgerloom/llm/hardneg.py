"""Hard-negative mining by exact inner products, several candidates to one multiplication.

Scores are Kronecker-packed products. Candidates of a block put a component each, made non-negative by a bias, into
separated fields of one wide integer, so there is one wide integer a component. An anchor multiplies each of them once by
its own biased component and adds them up; a field then holds the biased product of the anchor and one candidate, and as
fields are wide enough for the largest sum there is no carry between them. Taking off what the biases add gives exact
scores.

1. Components become floor(256 * x), labels of ids that ``shift_every`` divides move on by one.
2. Positives: anchors meet the rows of their own label, each task keeps the best of each anchor, the best of all tasks win.
3. Negatives: anchors meet all other rows; each positive's score gives a range of scores, in which the first rows count.

Anchors come in pieces of at most ``PIECE_BYTES``, ``PIECES`` of them to a job; rows stay where they are and are read once a
job. A task holds the anchors of a job's pieces, at most 64 MB of vectors (some 300 MB as Python numbers), a block of candidates
and the best rows of each anchor so far.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows equal in id, label and
vector count once. Rows that share an id but differ are rows of their own; they are never positives of each other. Vectors
of unequal lengths are compared as if the shorter one went on in zeros. Equal scores go by the smaller id. Scores are exact
at any size; one beyond 64 bits is ranked and given as null. An anchor without positives, and a positive without
negatives, give no rows; so does an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, written
from .topk import _key, _long, _whole

PIECE_BYTES = 8 << 20
PIECES = 8
#: Candidates whose components are packed into one wide integer.
PACKED = 1024


def labelled(vectors: DataFrame, shift_every: int, classes: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and x (components as doubles) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    label = F.col(label_col).cast("long")
    moved = F.when(F.col(id_col) % shift_every == 0, (label + 1) % classes).otherwise(label)
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), moved.alias("label"), x.alias("x")).distinct()


def whole_matrix(column: pa.ListArray, width: int, small: bool) -> np.ndarray:
    """floor(256 * x) as rows, padded with zeros; 64-bit numbers, or whole numbers of any size."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64 if small else object)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    place = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = np.floor(values * 256.0).astype(np.int64) if small else [_whole(v) for v in values.tolist()]
    return out


class Packed:
    """A block of candidates as one wide integer a component, and the scores of an anchor against all of them."""

    def __init__(self, x: np.ndarray, bias: int):
        self.n, self.width, self.bias = *x.shape, bias
        most = self.width * (2 * bias) ** 2
        self.bytes = 4 if most < 1 << 32 else 8 if most < 1 << 62 else (most.bit_length() + 7) // 8
        if self.bytes <= 8:
            fields = (x.T.astype(np.int64) + bias).astype(f"<u{self.bytes}")
            self.wide = [int.from_bytes(c.tobytes(), "little") for c in fields]
            # What the biases add to a candidate's field, but for the anchor's share.
            self.over = bias * x.sum(1, dtype=np.int64)
        else:
            self.wide = [int.from_bytes(b"".join((v + bias).to_bytes(self.bytes, "little") for v in c), "little") for c in x.T.tolist()]
            self.over = np.array([bias * sum(r) for r in x.tolist()], object)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products; ``anchor`` has the components as they are."""
        total = sum(map(mul, [a + self.bias for a in anchor], self.wide))
        raw = total.to_bytes(self.n * self.bytes, "little")
        share = self.bias * sum(anchor) + self.width * self.bias * self.bias
        if self.bytes <= 8:
            return np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64) - self.over - share
        fields = [int.from_bytes(raw[i : i + self.bytes], "little") for i in range(0, len(raw), self.bytes)]
        return np.array([f - share for f in fields], object) - self.over


class First:
    """The first n rows by score and id of each slot so far."""

    def __init__(self, slots: int, n: int):
        self.n = n
        self.rows: list[list[tuple]] = [[] for _ in range(slots)]
        self.floor: list[int | None] = [None] * slots

    def add(self, slot: int, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
        floor = self.floor[slot]
        at = np.flatnonzero(fits if floor is None else fits & (scores >= floor))
        if not len(at):
            return
        ids, scores = ids[at], scores[at]
        if len(at) > 4 * self.n and scores.dtype != object:
            # Scores below the n-th best of this block cannot come in.
            stay = scores >= np.partition(scores, len(scores) - self.n)[-self.n]
            ids, scores = ids[stay], scores[stay]
        best = sorted([*self.rows[slot], *zip(scores.tolist(), ids.tolist())], key=lambda r: (-r[0], r[1]))[: self.n]
        self.rows[slot] = best
        if len(best) == self.n:
            self.floor[slot] = best[-1][0]


#: What tasks give: the place of an anchor in its table, that of a positive, a row found and its score.
_FIELDS = "anchor long, slot int, vec_id long, score long, key binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    anchors, slots, ids, scores = zip(*rows) if rows else ((), (), (), ())
    arrays = [pa.array(anchors, pa.int64()), pa.array(slots, pa.int32()), pa.array(ids, pa.int64()), pa.array([_long(s) for s in scores], pa.int64()), pa.array([_key(s) for s in scores], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["anchor", "slot", "vec_id", "score", "key"])


def _range(positive: dict, share: tuple[int, int]) -> tuple[int, int]:
    """Whole scores from the low to the high share of a positive's, in percent; none where that is negative."""
    p = _unkey(positive["key"])
    return (-(-share[0] * p // 100), share[1] * p // 100) if p >= 0 else (1, 0)


def _unkey(key: bytes) -> int:
    """The whole number that ``_key`` made bytes of."""
    rest = int.from_bytes(key[5:], "big")
    return rest if key[0] else rest + 1 - (1 << 8 * (len(key) - 5))


def _meeting(pieces: list, shape: tuple[int, int, bool], n: int, share: tuple[int, int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a task against all anchors of the broadcast pieces: those of the anchor's label, or with ``share`` all
    others, within that share of the scores of the anchor's positives."""
    width, bias, small = shape
    same = share is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = []
        for piece in pieces:
            t = piece.value
            x = whole_matrix(t["x"], width, small).tolist()
            ranges = [[None]] * len(x) if same else [[_range(p, share) for p in near] for near in t["near"].to_pylist()]
            anchors += [(a, i, label, v, r) for a, i, label, v, r in zip(t["anchor"].to_pylist(), t["vec_id"].to_pylist(), t["label"].to_pylist(), x, ranges)]
        starts = np.cumsum([0, *(len(a[4]) for a in anchors)])
        best = First(int(starts[-1]), n)
        for batch in batches:
            order = np.argsort(batch.column(1).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            for at in range(0, batch.num_rows, PACKED):
                part = batch.slice(at, PACKED)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                packed = Packed(whole_matrix(part.column(2), width, small), bias)
                there = set(labels.tolist())
                for (_, own, label, v, ranges), start in zip(anchors, starts.tolist()):
                    if (label not in there) if same else (not ranges or there == {label}):
                        continue
                    scores = packed.scores(v)
                    if same:
                        best.add(start, ids, scores, (labels == label) & (ids != own))
                        continue
                    other = labels != label
                    for k, (lo, hi) in enumerate(ranges):
                        best.add(start + k, ids, scores, other & (scores >= lo) & (scores <= hi))
        rows = []
        for (a, *_, ranges), start in zip(anchors, starts.tolist()):
            for k in range(len(ranges)):
                rows += [(a, k, i, s) for s, i in best.rows[start + k]]
            if len(rows) > 1 << 16:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return run


def _met(rows: DataFrame, anchors: DataFrame, pieces: int, shape: tuple[int, int, bool], n: int, share: tuple[int, int] | None) -> DataFrame:
    """The first n rows of each anchor and slot, over all pieces."""
    context, out = rows.sparkSession.sparkContext, []
    for first in range(0, pieces, PIECES):
        sent = []
        for p in range(first, min(first + PIECES, pieces)):
            t = anchors.where(F.col("piece") == p).toArrow().combine_chunks()
            if t.num_rows:
                column = lambda name, t=t: c.combine_chunks() if isinstance(c := t.column(name), pa.ChunkedArray) else c
                sent.append(context.broadcast({name: column(name) for name in t.column_names}))
        if sent:
            found = rows.mapInArrow(_meeting(sent, shape, n, share), _FIELDS)
            order = Window.partitionBy("anchor", "slot").orderBy(F.desc("key"), "vec_id")
            out.append(written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n), "met"))
            for b in sent:
                b.destroy()
    if not out:
        return rows.sparkSession.createDataFrame([], f"{_FIELDS}, rank int")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    found._parts = out
    return found


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    shift_every: int = 7,
    classes: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id ``every`` divides; a negative's score lies between ``low`` and ``high`` percent of the
    positive's.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(labelled(vectors, shift_every, classes, id_col, vector_col, label_col), "vectors")
    size = rows.agg(F.max(F.array_max(F.transform("x", lambda e: F.abs(e)))).alias("most"), F.max(F.size("x")).alias("width"), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long")).alias("anchors")).first()
    width, most = max(1, size["width"] or 1), size["most"] or 0.0
    bias = abs(_whole(-most)) + 1
    shape = (width, bias, bias < 1 << 30)
    pieces = max(1, -(-(size["anchors"] or 0) // max(1, piece_bytes // (8 * (width + 8)))))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("anchor", F.monotonically_increasing_id())
    asked = written(asked.withColumn("piece", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(pieces))), "anchors")
    near = _met(rows, asked, pieces, shape, positives, None)

    best = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score", "key"))).alias("near"))
    chosen = written(asked.join(best, "anchor"), "chosen")
    far = _met(rows, chosen, pieces, shape, negatives, (low, high))
    out = far.join(chosen.select("anchor", F.col("vec_id").alias("anchor_id"), "near"), "anchor").withColumn("positive", F.col("near")[F.col("slot")])
    out = out.select("anchor_id", F.col("positive.positive_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
    out = written(out, "negatives")
    discard(rows, asked, chosen, *getattr(near, "_parts", []), *getattr(far, "_parts", []))
    return out
