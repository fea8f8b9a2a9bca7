"""Whitening against the eigenvectors of the covariance, made in one piece."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import entries, whitening


def check(found, rows, components):
    """``found`` against a fit in exact sums and numpy's eigenvectors, up to signs."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = [[n * int(a) - int(s) for a, s in zip(row, sums)] for row in x]
    centred = np.array([[a / n for a in row] for row in apart])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    expected = centred @ vectors[:, :components] / np.sqrt(values[:components])
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(rows) * components and all(r.n == n for r in found)
    got = np.array([[by_row[i][k + 1].whitened for k in range(components)] for i, _ in rows])
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * signs).max() < 1e-6
    assert [by_row[i][1].deviation for i, _ in rows] == [sum(a * a for a in row) for row in apart]
    for k in range(components):
        assert by_row[rows[0][0]][k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert len({r.identity_error for r in found}) == 1
    assert abs(found[0].identity_error - np.abs(got.T @ got / n - np.eye(components)).max()) < 1e-9
    assert found[0].identity_error < 1e-6


def frame(spark, vectors):
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(vectors)]
    return entries.importable(spark).createDataFrame(rows, "vec_id long, embedding array<double>"), rows


def test_op12(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    check(entries.op12_embedding_whitening(spark, sf).collect(), usable, 32)


def test_dimensions_that_repeat_or_stand_still(spark):
    base = np.random.default_rng(0).integers(-40, 40, size=(40, 3)) / 8
    df, rows = frame(spark, np.hstack([base, base[:, :1], np.zeros((40, 2))]))
    check(whitening.whiten(df).collect(), rows, 3)


def test_equal_deviations(spark):
    corners = np.vstack([np.eye(5), -np.eye(5)])
    df, _ = frame(spark, corners)
    found = whitening.whiten(df).collect()
    assert {r.component for r in found} == {1, 2, 3, 4, 5}
    assert all(r.explained == pytest.approx(0.2) for r in found) and found[0].identity_error < 1e-12


def test_deviations_of_very_different_size(spark):
    df, rows = frame(spark, np.random.default_rng(1).normal(size=(200, 4)) * [1e4, 10, 1, 0.1])
    check(whitening.whiten(df).collect(), rows, 4)


def test_rows_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (None, [2.0, 1.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 1.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, embedding array<double>, n string, x int")
    found = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in found) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert whitening.whiten(df.where("vec_id = 1")).collect() == []
    assert whitening.whiten(df.where("vec_id = 3")).collect() == []
    assert whitening.whiten(df.limit(0)).collect() == []


def test_deviations_beyond_64_bits_are_null(spark):
    df, _ = frame(spark, [[0.0, 0.0], [1e9, 0.0], [-1e9, 1.0]])
    found = {(r.vec_id, r.component): r.deviation for r in whitening.whiten(df).collect()}
    assert len(found) == 6 and set(found.values()) == {None, 4096}
