"""Truncated SVD of a sparse table by randomised subspace iteration, with both factors as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..sources.scratch import written
from .vectors import BATCH_BYTES, arrow_batches

#: Rows of a block of results at most, of a piece of it that is a row of a table, and into how many blocks a short side is cut all the same.
BLOCK, PIECE, SPREAD = 1 << 17, 1 << 13, 16
#: Cells that a tile holds at most, and that a task multiplies at a time.
CELLS = 100_000


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _gram(blocks: DataFrame, width: int) -> np.ndarray:
    """X'X of the vectors in blocks: a task sends width x width sums, whatever the number of its rows."""

    def run(batches):
        g = np.zeros((width, width))
        for batch in batches:
            for flat in batch.column(0):
                x = np.frombuffer(flat.as_buffer()).reshape(-1, width)
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size)), pa.array(g.ravel())], ["i", "x"])

    sums, out = blocks.select("flat").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")), np.zeros(width * width)
    with arrow_batches(blocks.sparkSession, BATCH_BYTES):
        for r in sums.collect():
            out[r["i"]] = r["x"]
    return out.reshape(width, width)


def _turned(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the eigenvalues, falling, and the eigenvectors; directions without weight are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values > max(values.max(initial=0), 0) * 1e-12
    return np.sqrt(values[keep]), vectors[:, keep]


class _Side:
    """The distinct keys of one side of the table, numbered, and the blocks and their pieces that their numbers make."""

    def __init__(self, cells: DataFrame, key: str):
        self.key, self.keys = key, written(numbered(cells.select(key).distinct(), key, f"{key}_at"), "numbers")
        self.n = self.keys.count()
        most = max(1, min(BLOCK, -(-self.n // SPREAD)))
        self.piece = min(PIECE, most)
        self.each = most // self.piece
        self.size = self.piece * self.each
        self.blocks, self.pieces = (max(1, -(-self.n // k)) for k in (self.size, self.piece))

    def block(self, size: int):
        return F.floor(F.col(f"{self.key}_at") / size).cast("int")

    def inside(self, size: int):
        return (F.col(f"{self.key}_at") % size).cast("int")

    def start(self, width: int, seed: int) -> DataFrame:
        """piece, flat: hashes of the keys."""
        size, packed = self.size, self.packed()
        start = F.array(*[(F.xxhash64(self.key, F.lit(seed), F.lit(i)) / F.lit(float(1 << 63))) for i in range(width)])

        def run(batches):
            out = {}
            for batch in batches:
                if batch.num_rows:
                    block, at = (batch.column(i).to_numpy() for i in range(2))
                    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    for b in np.unique(block):
                        out.setdefault(b, np.zeros((size, width)))[at[block == b]] = x[block == b]
            yield from packed(out)

        rows = self.keys.select(self.block(size).alias("block"), self.inside(size).alias("at"), start.alias("v")).repartitionById(self.blocks, "block")
        return written(rows.mapInArrow(run, "piece int, flat binary"), "start")

    def packed(self):
        """What makes a row per piece, its number and its numbers' bytes, of blocks of results."""
        each, piece, pieces = self.each, self.piece, self.pieces

        def run(blocks: dict):
            for b, x in blocks.items():
                for i in range(min(each, pieces - b * each)):
                    flat = x[i * piece : (i + 1) * piece].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([b * each + i], pa.int32()), pa.array([flat], pa.binary())], ["piece", "flat"])

        return run

    def rows(self, blocks: DataFrame, width: int, m: np.ndarray, name: str) -> DataFrame:
        """key, name: the vectors in pieces times a small matrix, a row per key."""
        size, n = self.piece, self.n

        def run(batches):
            for batch in batches:
                for block, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = np.frombuffer(flat.as_buffer()).reshape(-1, width)[: n - block * size] @ m
                    for a in range(0, len(x), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, min(a + 10_000, len(x))) + block * size), _arrays(x[a : a + 10_000])], ["at", "v"])

        each = blocks.mapInArrow(run, "at long, v array<double>")
        return self.keys.join(each, F.col(f"{self.key}_at") == F.col("at")).select(self.key, F.col("v").alias(name))


def _tiles(coded: DataFrame, to: _Side, by: _Side) -> DataFrame:
    """t, b (numbers of a block of `to` and of a piece of `by`), and at, of, w: the places inside them and the weights of their
    cells, as bytes. A crowded tile has several such rows. Cells are put in order and cut as they come, so no tile is gathered."""
    parts = 1 + coded.count() // (CELLS * to.blocks * by.pieces)
    part = F.pmod(F.xxhash64(f"{to.key}_at", f"{by.key}_at"), F.lit(parts))
    rows = coded.select(to.block(to.size).alias("t"), by.block(by.piece).alias("b"), to.inside(to.size).alias("at"), by.inside(by.piece).alias("of"), "w", part.alias("part"))
    rows = rows.repartition("t", "b", "part").sortWithinPartitions("t", "b").select("t", "b", "at", "of", "w")

    def run(batches):
        key, held, n = None, [], 0

        def tile():
            parts = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held)]
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], *parts], ["t", "b", "at", "of", "w"])

        for batch in batches:
            t, b, *x = (batch.column(c).to_numpy() for c in range(5))
            cuts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (b[1:] != b[:-1])]) if len(t) else []
            cuts = np.union1d(cuts, np.arange(0, len(t), CELLS)).astype(int)
            for lo, hi in zip(cuts, [*cuts[1:], len(t)]):
                if n and (key != (t[lo], b[lo]) or n + hi - lo > CELLS):
                    yield tile()
                    held, n = [], 0
                key, n = (t[lo], b[lo]), n + hi - lo
                held.append([c[lo:hi] for c in x])
        if n:
            yield tile()

    return written(rows.mapInArrow(run, "t int, b int, at binary, of binary, w binary"), "tiles")


def _product(tiles: DataFrame, vectors: DataFrame, m: np.ndarray, to: _Side) -> DataFrame:
    """piece, flat of the side `to`: the table, or its transpose, as tiles, times the vectors times m.

    The tiles of a block of results lie in one task, which keeps the block's sums while the vectors pass piece by piece,
    read from where they were written. So only tiles are shuffled, and neither a vector nor a sum per cell; and a task
    holds the sums of one block and a few pieces, however long the sides are."""
    size, packed = to.size, to.packed()

    def run(batches):
        sums, last, v = {}, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                t, b = (batch.column(c)[i].as_py() for c in range(2))
                if b != last:
                    last, v = b, np.frombuffer(batch.column(2)[i].as_buffer()).reshape(-1, len(m)) @ m
                at, of, w = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in ((3, np.int32), (4, np.int32), (5, float)))
                y, order = sums.setdefault(t, np.zeros((size, m.shape[1]))), np.argsort(at, kind="stable")
                for a in range(0, len(at), CELLS):
                    o = order[a : a + CELLS]
                    heads = np.flatnonzero(np.r_[True, at[o][1:] != at[o][:-1]])
                    y[at[o][heads]] += np.add.reduceat(w[o, None] * v[of[o]], heads)
        yield from packed(sums)

    near = tiles.repartitionById(to.blocks, "t")
    met = vectors.coalesce(1).join(near.hint("shuffle_replicate_nl"), F.col("piece") == F.col("b"))
    with arrow_batches(tiles.sparkSession, BATCH_BYTES):
        return written(met.select("t", "b", "flat", "at", "of", "w").mapInArrow(run, "piece int, flat binary"), "product")


def truncated_svd(cells: DataFrame, row: str, column: str, weight: str, k: int, rounds: int = 5, extra: int = 10, seed: int = 7) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(row, u = U S), (column, v = V) and the singular values of the table's k leading directions.

    cells: row, column, weight, a row per pair of keys, neither null. A random start of k + extra directions is multiplied by the table and its
    transpose `rounds` times, each product tile by tile, orthonormalised by what its Gram matrix says;
    only such matrices, (k + extra) squared numbers, reach the driver. Fewer directions come back where the table has no
    more. The start is a hash of the column's value, so reruns agree."""
    cells = written(cells.select(row, column, F.col(weight).cast("double").alias("w")).where(F.col("w").isNotNull() & (F.col("w") != 0) & F.col(row).isNotNull() & F.col(column).isNotNull()), "cells")
    r, c = _Side(cells, row), _Side(cells, column)
    coded = written(cells.join(r.keys, row).join(c.keys, column).select(f"{row}_at", f"{column}_at", "w"), "coded")
    onto_r, onto_c = _tiles(coded, r, c), _tiles(coded, c, r)
    v, m = c.start(k + extra, seed), np.eye(k + extra)  # the directions are v times m
    for _ in range(rounds):
        y = _product(onto_r, v, m, r)
        s, q = _turned(_gram(y, m.shape[1]))
        if not len(s):
            break
        z = _product(onto_c, y, q / s, c)
        s, q = _turned(_gram(z, q.shape[1]))
        v, m = z, q / s
    y = _product(onto_r, v, m, r)
    s, q = _turned(_gram(y, m.shape[1]))
    q, s = q[:, :k], s[:k]
    return r.rows(y, m.shape[1], q, "u"), c.rows(v, len(m), m @ q, "v"), s
