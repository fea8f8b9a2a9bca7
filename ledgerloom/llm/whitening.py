"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, so sums, and rows centred by them, are exact. With the centred
rows as matrix X, the method alternates two distributed products: p = Xv of a direction v, and
X'u of the unit vector u that is left of p without its parts along earlier u's (Golub and
Kahan, 1965). X'u without its parts along all earlier v's is the next direction. All directions
are kept orthogonal in full: the v's, which have one entry per dimension, on the driver; the
u's, which have one entry per row, in the tasks, where each is made anew as Xc from a driver-held
vector c. So a row is read, never moved, and a pass brings back one number per dimension. The
singular values of the small bidiagonal matrix are those of X, and its right singular vectors
turn the v's into components. A direction that ends its space (equal or zero deviations) is
followed by a random one orthogonal to all before, until every dimension is used up.

Defined results: vectors that are null or empty, hold a null, a component that is not finite or one beyond
2**52 / scale take no part, nor those whose length is not the most frequent one (the longer of
equally frequent ones). Rows that repeat and rows without an id count and are returned as often as they
come. Components without deviation (below 1e-11 of the largest) have no whitened value and are
left out, so equal rows, a single row and an empty table give an empty result. A ``deviation``
that does not fit 64 bits is null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.session import stage

SCALE, OFFSET = 64, 1_000_000   # entry c becomes floor(SCALE * c) + OFFSET
TINY = 1e-11                    # of the largest deviation: no deviation
ROWS = 1 << 16                  # result rows made at once
BLOCK = 4096                    # rows of a block


@dataclass
class Whitening:
    """What was fitted: count and sums of the whole-number rows, components, deviations."""

    n: int
    sums: np.ndarray
    components: np.ndarray      # one unit vector per column
    deviations: np.ndarray      # standard deviation along each
    trace: float                # of the covariance

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (self.n * rows - self.sums) / self.n

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ self.components / self.deviations


def whole_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): usable vectors as whole numbers, written to the shared folder."""
    wide = F.col(vector).cast("array<double>")
    limit = float(2**52 // SCALE)
    kept = df.select(F.col(id_col).alias("id"), wide.alias("c")).where(
        (F.size("c") > 0) & F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= limit)))
    x = F.transform("c", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET).cast("long"))
    rows = stage(kept.select("id", x.alias("x")), "whole-rows")
    usual = rows.groupBy(F.size("x").alias("k")).agg(F.count("*").alias("n")).agg(F.max_by("k", F.struct("n", "k"))).first()[0]
    return rows.where(F.size("x") == (usual or 0))


def blocks(rows: DataFrame) -> DataFrame:
    """(x): the rows packed into matrices of up to ``BLOCK`` rows, written once. All passes read these."""
    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([x[at:at + BLOCK].tobytes() for at in range(0, len(x), BLOCK)], pa.binary())], names=["x"])

    return stage(rows.select("x").mapInArrow(pack, "x binary"), "blocks")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(packed: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], kind: type = float) -> np.ndarray:
    """The sum over all blocks of ``part``, which maps a matrix of rows to a vector of numbers.

    A task adds up its own; the tasks' sums meet by position.
    """
    name = "long" if kind is int else "double"

    def add(batches):
        total = None
        for batch in batches:
            for block in batch.column(0):
                found = part(np.frombuffer(block.as_py(), np.int64).reshape(-1, dims))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "part"])

    parts = packed.mapInArrow(add, f"at long, part {name}").groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(len(parts), np.int64 if kind is int else float)
    for row in parts:
        out[row.at] = row.part
    return out


def bidiagonal(packed: DataFrame, centred: Callable[[np.ndarray], np.ndarray], dims: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) such that X = U B V' with orthonormal columns: V by dimension and step, B upper bidiagonal."""
    rng = np.random.default_rng(seed)
    v, b, c = np.zeros((dims, dims)), np.zeros((dims, dims)), np.zeros((dims, dims))

    def orthogonal(w: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):  # twice is enough
            w = w - v[:, :k] @ (v[:, :k].T @ w)
        return w

    def fresh(k: int) -> np.ndarray:
        w = orthogonal(rng.normal(size=dims), k)
        return w / np.linalg.norm(w)

    largest = 0.0
    v[:, 0] = fresh(0)
    for k in range(dims):
        along, before = v[:, k].copy(), c[:, :k].copy()

        def xv(x: np.ndarray) -> np.ndarray:
            x = centred(x)
            p = x @ along
            return np.append((x @ before).T @ p, p @ p)

        found = summed(packed, dims, xv)
        # What p has along earlier u's; only the one before it in exact arithmetic.
        shares = found[:-1]
        if k:
            b[k - 1, k] = shares[k - 1]
        next_c = along - before @ shares

        def xu(x: np.ndarray) -> np.ndarray:
            x = centred(x)
            u = x @ next_c
            return np.concatenate([x.T @ u, [u @ u], (x @ before).T @ u])

        found = summed(packed, dims, xu)
        product, alpha, left = found[:dims], np.sqrt(max(found[dims], 0.0)), found[dims + 1:]
        largest = max(largest, alpha, abs(b[k - 1, k]) if k else 0.0)
        if largest == 0.0 or alpha <= largest * 1e-14:
            product, alpha = np.zeros(dims), 0.0
        else:
            b[k, k], c[:, k] = alpha, (next_c - before @ left) / alpha
            product = product / alpha
        if k + 1 < dims:
            w = orthogonal(product, k + 1)
            beta = np.linalg.norm(w)
            v[:, k + 1] = w / beta if beta > largest * 1e-13 else fresh(k + 1)
    return v, b


def fit(packed: DataFrame, n: int, dims: int, components: int = 32) -> Whitening | None:
    """Fit on blocks of ``n`` rows; nothing where none deviates."""
    sums = summed(packed, dims, lambda x: x.sum(axis=0), int)
    made = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    made.trace = float(summed(packed, dims, lambda x: np.array([np.square(made.centred(x)).sum()]))[0]) / n
    if made.trace == 0.0:
        return None
    centred = made.centred
    v, b = bidiagonal(packed, centred, dims)
    _, singular, right = np.linalg.svd(b)
    kept = [k for k in range(min(components, dims)) if singular[k] > singular[0] * TINY]
    made.components = v @ right[kept].T
    made.components /= np.linalg.norm(made.components, axis=0)
    made.deviations = singular[kept] / np.sqrt(n)
    return made


def identity_error(packed: DataFrame, made: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over all rows, centred before multiplying."""
    k, dims = len(made.deviations), len(made.sums)
    mean = summed(packed, dims, lambda x: made.apply(x).sum(axis=0)) / made.n

    def product(x: np.ndarray) -> np.ndarray:
        w = made.apply(x) - mean
        return (w.T @ w).ravel()

    return float(np.abs(summed(packed, dims, product).reshape(k, k) / made.n - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component."""
    rows = whole_rows(df, id_col, vector)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    packed = blocks(rows) if n else rows
    made = fit(packed, n, dims, components) if n else None
    if made is None:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(packed, made), len(made.deviations)
    explained = np.square(made.deviations) / made.trace
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def write(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS // k + 1):
                part = batch.slice(start, ROWS // k + 1)
                x, m = matrix(part.column(1)), part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, made.n)), deviations(x, made).take(pa.array(np.repeat(np.arange(m), k))), pa.array(made.apply(x).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names=names)

    return rows.select("id", "x").mapInArrow(write, schema)


def deviations(x: np.ndarray, made: Whitening) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 for each row, exact; null beyond 64 bits."""
    apart = made.n * x - made.sums
    if float(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] < 2.0**62:
        return pa.array(np.square(apart).sum(axis=1))
    exact = [sum(a * a for a in row) for row in apart.tolist()]
    return pa.array([d if d < 2**63 else None for d in exact], pa.int64())
