"""The fit of the classifier against all rows at once, without partitions or normal equations."""

import numpy as np
import pytest

from ledgerloom.llm import quality
from ledgerloom.llm.workers import importable


def test_isotonic_is_the_largest_least_mean():
    rng = np.random.default_rng(31)
    for n in (0, 1, 2, 7, 40):
        values, weights = np.round(rng.random(n), 1), rng.integers(1, 5, n).astype(float)
        mean = lambda i, j: np.average(values[i:j + 1], weights=weights[i:j + 1])
        wanted = [max(min(mean(i, j) for j in range(at, n)) for i in range(at + 1)) for at in range(n)]
        assert quality.isotonic(values, weights) == pytest.approx(wanted)


def test_fit_equals_one_least_squares_problem(spark):
    importable(spark)
    rng = np.random.default_rng(32)
    k, n = len(quality.STATISTICS), 600
    x = rng.normal(size=(n, k)) * rng.uniform(0.5, 20, k) + rng.uniform(-5, 5, k)
    x[:, 0] = 3.0                                     # a statistic that never varies
    y = (x[:, 1] + rng.normal(size=n) * 3 > x[:, 1].mean()).astype(int)
    fold = np.arange(n) % 4 == 3
    rows = spark.createDataFrame([(a.tolist(), int(b), bool(c)) for a, b, c in zip(x, y, fold)],
                                 "_stats array<double>, _label int, _fold boolean").repartition(5)
    model = quality.fit(rows, waves=24, bandwidth=3.0, ridge=0.5)

    train = x[~fold]
    mean, scale = train.mean(axis=0), np.maximum(train.std(axis=0), 1e-6)

    def features(row):
        z = [min(4.0, max(-4.0, v)) for v in (row - mean) / scale]
        waves = [np.sqrt(2 / 24) * np.cos(sum(a * b for a, b in zip(z, f)) + p) for f, p in zip(model.frequencies.T, model.phases)]
        return [*waves, *z, 1.0]

    made = np.array([features(r) for r in x])
    # Ridge as plain least squares with one more row per weight.
    stacked = np.vstack([made[~fold], np.sqrt(0.5) * np.eye(made.shape[1])])
    weights = np.linalg.lstsq(stacked, np.concatenate([y[~fold], np.zeros(made.shape[1])]), rcond=None)[0]
    raw = made @ weights
    assert model.raw(x) == pytest.approx(raw, abs=1e-7)

    groups = {}
    for r, label in zip(raw[fold], y[fold]):
        groups.setdefault(min(max(int(np.floor((r + 0.5) / 2 * quality.BINS)), 0), quality.BINS - 1), []).append((r, label))
    at = [np.mean([r for r, _ in groups[b]]) for b in sorted(groups)]
    share = np.array([0.0, *[np.mean([label for _, label in groups[b]]) for b in sorted(groups)], 1.0])
    count = np.array([1.0, *[len(groups[b]) for b in sorted(groups)], 1.0])
    ends = [min(at[0], 0.0) - 0.5, *at, max(at[-1], 1.0) + 0.5]
    assert model.score(x) == pytest.approx(np.interp(raw, ends, quality.isotonic(share, count)), abs=1e-6)
