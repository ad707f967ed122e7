"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into 1, 4, 16, ... segments of equal length. Means and deviations of a segment bound the
squared distance of two vectors from below: m ((mean_q - mean_x)^2 + (dev_q - dev_x)^2) a segment of m parts.
As 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2, that bounds the inner product from above.

1. Rows are written in the order of a code of their coarse segment means, so that rows of a block are alike.
2. Each query gets a floor: its k-th score among ``SEEDS`` rows, chosen by a hash of their ids. It only saves work.
3. Queries go to all tasks in pieces of bounded size; rows stay where they are. A task takes its rows block by block.
   Ranges of a block's statistics rule out whole blocks for a query; then levels are tried from coarse to fine, each
   only for the pairs that the one before left; what stays is computed exactly, in whole numbers. The k best rows so far
   of each query raise its floor. A task gives at most k rows a query, and the best of all tasks are the result.

Vectors that are null or hold null or non-finite parts take no part. Vectors of unequal lengths are
compared as if the shorter one went on in zeros. Equal scores go by the smaller id. Rows of one id count as one, with
the best of their scores; a query does not meet rows of its own id. Scores are exact at any size; one beyond 64 bits
is ranked and given as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Queries of one piece hold so many bytes at most; it is what a broadcast holds.
PIECE_BYTES = 16 << 20
QUERY_BLOCK = 1024
ROW_BLOCK = 2048
SEEDS = 2048
#: Where more than this share of pairs is left, a level is computed for all pairs of a block, as one product of matrices.
DENSE = 0.25


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (parts as doubles) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def levels(width: int) -> list[int]:
    """Segments by level: 1, 4, 16, ... while a segment keeps four parts at least."""
    out, n = [], 1
    while width // n >= 4 and width % n == 0:
        out.append(n)
        n *= 4
    return out


def statistics(x: np.ndarray, n: int) -> np.ndarray:
    """Means and deviations of n segments a row, side by side, scaled so that a product of two rows is a bound."""
    s = x.reshape(len(x), n, -1)
    return np.concatenate([s.mean(2), s.std(2)], 1) * math.sqrt(s.shape[2])


def block_bound(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bounds of queries over all rows of a block, from the ranges of the block's statistics."""
    lo, hi = x.min(0), x.max(0)
    return np.maximum(q * lo, q * hi).sum(1)


class Best:
    """The k best rows of each query so far: distinct ids, by score and then by id."""

    def __init__(self, floors: np.ndarray, k: int):
        n = len(floors)
        self.k, self.floor = k, floors
        self.q, self.id, self.s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, floors.dtype if n else np.float64)

    def add(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, s = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.s, s])
        order = np.lexsort((-s, ids, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, s = q[first], ids[first], s[first]
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        kth = rank == self.k - 1
        self.floor[q[kth]] = np.maximum(self.floor[q[kth]], s[kth])
        keep = rank < self.k
        self.q, self.id, self.s = q[keep], ids[keep], s[keep]


def search(best: Best, at: int, qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, left: list[int] | None = None) -> None:
    """Adds to ``best`` what a block of rows with distinct ids has for a block of queries, which begins at place ``at``.

    ``left`` gets the number of pairs that are still in play before each level, and those computed exactly.
    """
    width = min(q.shape[1], x.shape[1])
    q, x = q[:, :width], x[:, :width]
    floor = best.floor[at : at + len(q)]
    real = lambda v: v.astype(np.float64)
    slack = 1e-9 * (1.0 + float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, width))
    steps = levels(width)
    stats = [(statistics(real(q), n), statistics(real(x), n)) for n in steps]
    rows = np.arange(len(q))
    for sq, sx in stats:
        rows = rows[block_bound(sq[rows], sx) + slack >= floor[rows]]
    # Pairs in play: a mask while there are many, places of queries and rows after that.
    mask, pairs = qid[rows][:, None] != xid[None, :], None

    def narrowed() -> int:
        nonlocal mask, pairs
        n = int(mask.sum()) if pairs is None else len(pairs[0])
        if pairs is None and n <= DENSE * mask.size:
            i, j = np.nonzero(mask)
            pairs = rows[i], j
        return n

    for sq, sx in stats:
        n = narrowed()
        if left is not None:
            left.append(n)
        if not n:
            break
        if pairs is None:
            mask &= sq[rows] @ sx.T + slack >= floor[rows][:, None]
        else:
            stay = np.einsum("ij,ij->i", sq[pairs[0]], sx[pairs[1]]) + slack >= floor[pairs[0]]
            pairs = pairs[0][stay], pairs[1][stay]
    n = narrowed()
    if left is not None:
        left.append(n)
    if not n:
        return
    if pairs is None:
        s = q[rows] @ x.T
        i, j = np.nonzero(mask & (s >= floor[rows][:, None]))
        best.add(rows[i] + at, xid[j], s[i, j])
    else:
        i, j = pairs
        s = np.einsum("ij,ij->i", q[i], x[j])
        stay = s >= floor[i]
        best.add(i[stay] + at, xid[j[stay]], s[stay])


def _layers(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of a block in which each id stands once; rows that repeat id and vector are left out."""
    if len(np.unique(ids)) == len(ids):
        yield ids, x
        return
    seen, turn, place = set(), np.zeros(len(ids), np.int64), {}
    for i, key in enumerate(zip(ids.tolist(), map(bytes, np.ascontiguousarray(x)))):
        turn[i] = -1 if key in seen else place.get(key[0], 0)
        if key not in seen:
            seen.add(key)
            place[key[0]] = place.get(key[0], 0) + 1
    for t in range(turn.max() + 1):
        yield ids[turn == t], x[turn == t]


def _matrix(column: pa.ListArray, dtype) -> np.ndarray:
    """Vectors as rows, floor(256 * x), padded with zeros to the longest one and to whole segments."""
    if not len(column):
        return np.zeros((0, 4), dtype)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    width = -(-int(sizes.max(initial=1)) // 4) * 4
    out = np.zeros((len(sizes), width), dtype)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    place = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = [_whole(v) for v in values.tolist()] if dtype is object else np.floor(values * 256.0).astype(dtype)
    return out


def _whole(v: float) -> int:
    return int(v) * 256 if abs(v) > 1 << 53 else math.floor(v * 256.0)


def _key(s: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    size = (abs(s).bit_length() + 7) // 8
    if s >= 0:
        return b"\x01" + size.to_bytes(4, "big") + s.to_bytes(size, "big")
    return b"\x00" + ((1 << 32) - 1 - size).to_bytes(4, "big") + ((1 << 8 * size) - 1 + s).to_bytes(size, "big")


def _long(s: int) -> int | None:
    return s if -(1 << 63) <= s < 1 << 63 else None


_FIELDS = "query_id long, vec_id long, score long, key binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["query_id", "vec_id", "score", "key"])


def _searcher(piece, kind: str, k: int):
    """A function over the rows of a task for a broadcast piece of queries: ids, vectors and floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, column, floors = piece.value
        if kind == "big":
            yield from _big(qid, _matrix(column, object), batches, k)
            return
        dtype = np.dtype(kind)
        q = _matrix(column, dtype)
        best = Best(floors.astype(dtype) if kind != "int64" else np.where(np.isfinite(floors), floors, np.iinfo(np.int64).min).astype(np.int64), k)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dtype)
            for at in range(0, len(ids), ROW_BLOCK):
                for xid, rows in _layers(ids[at : at + ROW_BLOCK], x[at : at + ROW_BLOCK]):
                    for b in range(0, len(qid), QUERY_BLOCK):
                        search(best, b, qid[b : b + QUERY_BLOCK], q[b : b + QUERY_BLOCK], xid, rows)
        for at in range(0, len(best.q), 1 << 16):
            part = slice(at, at + (1 << 16))
            n = len(best.q[part])
            yield pa.RecordBatch.from_arrays([pa.array(qid[best.q[part]], pa.int64()), pa.array(best.id[part], pa.int64()), pa.array(best.s[part].astype(np.int64)), pa.nulls(n, pa.binary())], names=["query_id", "vec_id", "score", "key"])

    return run


def _big(qid: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Whole numbers of any size, pair by pair."""
    best: list[dict[int, int]] = [{} for _ in qid]
    for batch in batches:
        x = _matrix(batch.column(1), object)
        width = min(q.shape[1], x.shape[1])
        for xid, row in zip(batch.column(0).to_pylist(), x[:, :width]):
            for i, s in enumerate((q[:, :width] @ row).tolist()):
                if xid != qid[i]:
                    top = best[i]
                    top[xid] = max(s, top.get(xid, s))
                    if len(top) > 4 * k:
                        best[i] = dict(sorted(top.items(), key=lambda r: (-r[1], r[0]))[:k])
    for i, top in zip(qid.tolist(), best):
        rows = [(i, j, _long(s), _key(s)) for j, s in sorted(top.items(), key=lambda r: (-r[1], r[0]))[:k]]
        if rows:
            yield _found(rows)


def _coded(rows: DataFrame) -> DataFrame:
    """Rows with a code: the means of four segments, as bytes around the middle, their bits in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), np.float64)
            means = x.reshape(len(x), 4, -1).mean(2) if len(x) else np.zeros((0, 4))
            spread = np.sqrt((x * x).mean(1, keepdims=True)) + 1e-300
            with np.errstate(invalid="ignore", over="ignore"):
                level = np.nan_to_num(np.clip(128 + 128 * means / spread, 0, 255)).astype(np.int64)
            code = np.zeros(len(x), np.int64)
            for bit in range(7, -1, -1):
                for c in range(4):
                    code = code * 2 + (level[:, c] >> bit & 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code)], names=["vec_id", "x", "code"])

    return rows.mapInArrow(run, "vec_id long, x array<double>, code long")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    coded = _coded(quantized(vectors, id_col, vector_col))
    rows = written(coded.repartitionByRange("code", F.xxhash64("vec_id")).sortWithinPartitions("code").select("vec_id", "x"), "vectors")
    most = F.array_max(F.transform("x", lambda e: F.abs(e)))
    size = rows.agg(F.max(most).alias("most"), F.max(F.size("x")).alias("width")).first()
    width, most = max(1, size["width"] or 1), 256.0 * (size["most"] or 0.0) + 1
    # Products in doubles, in 64-bit numbers or in numbers of any size, whichever is exact.
    kind = "float64" if most * most * width < 1 << 52 else "int64" if most * most * width < 1 << 62 else "big"
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "x"])
    seeds = spark.sparkContext.broadcast(_collected(rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS)))

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, column = seeds.value
        for batch in batches:
            floors = np.full(batch.num_rows, -np.inf)
            if kind != "big" and len(ids) and batch.num_rows:
                best, q = Best(floors, k), _matrix(batch.column(1), np.float64)
                x = _matrix(column, np.float64)
                for xid, part in _layers(ids, x):
                    for b in range(0, len(q), QUERY_BLOCK):
                        search(best, b, batch.column(0).to_numpy()[b : b + QUERY_BLOCK], q[b : b + QUERY_BLOCK], xid, part)
                floors = best.floor if kind == "float64" else best.floor - 1e-9 * np.abs(best.floor) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors)], names=["vec_id", "x", "floor"])

    asked = asked.mapInArrow(floored, "vec_id long, x array<double>, floor double")
    each = max(1, piece_bytes // (8 * (width + 4)))
    pieces = max(1, -(-rows.where(F.pmod("vec_id", F.lit(every)) == 0).count() // each))
    asked = written(asked.withColumn("piece", F.pmod(F.xxhash64("vec_id", "x"), F.lit(pieces))), "queries")
    out = []
    for p in range(pieces):
        ids, column, floors = _collected(asked.where(F.col("piece") == p).drop("piece"))
        if len(ids):
            made = _best(rows.mapInArrow(_searcher(spark.sparkContext.broadcast((ids, column, floors)), kind, k), _FIELDS), kind, k)
            out.append(written(made, "found") if pieces > 1 else made)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    discard(asked)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    best = _best(found, kind, k) if pieces > 1 else found
    return best.select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, kind: str, k: int) -> DataFrame:
    """The k best rows of each query; rows of one id count once. Only big scores need their keys."""
    by = "key" if kind == "big" else "score"
    top = F.max_by("score", "key").alias("score") if kind == "big" else F.max("score").alias("score")
    found = found.groupBy("query_id", "vec_id").agg(top, F.max("key").alias("key")) if kind == "big" else found.groupBy("query_id", "vec_id").agg(top)
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _collected(df: DataFrame) -> tuple:
    """Columns of a table of bounded size: ids and floors as arrays, vectors as an Arrow column."""
    table = df.toArrow().combine_chunks()
    columns = []
    for c in table.columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        columns.append(c if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False))
    return tuple(columns)
