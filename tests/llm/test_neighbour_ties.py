"""Exact ties among copies, bounded runs and small tables, at the parameters of the query."""

import numpy as np

from ledgerloom.llm import neighbours
from ledgerloom.llm.workers import importable


def table(spark, vectors):
    importable(spark)
    return spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<double>")


def found(df, asked):
    out = {}
    for r in neighbours.nearest(df, asked, neighbours.Hashing(64)).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [rows[k] for k in sorted(rows)] for q, rows in out.items()}


def test_copies_tie_by_id_across_cells(spark):
    rng = np.random.default_rng(21)
    one, rest = rng.normal(size=64), rng.normal(size=(1000, 64))
    df = table(spark, [(k, one) for k in range(1400)] + [(5000 + k, v) for k, v in enumerate(rest)])
    got = found(df, df.where("vec_id % 100 = 0"))
    for q in range(0, 1400, 100):
        assert [v for v, _ in got[q]] == [k for k in range(6) if k != q][:5]
        assert len({s for _, s in got[q]}) == 1
    assert len({s for q in range(0, 1400, 100) for _, s in got[q]}) == 1


def test_query_blocks_bound_a_run_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(22)
    df = table(spark, [(k, v) for k, v in enumerate(rng.normal(size=(300, 64)))])
    whole = found(df, df)
    sizes, own = [], neighbours.over_runs

    def watched(rows, keys, *rest):
        sizes.append(rows.where("query").groupBy(*keys).count().agg({"count": "max"}).first()[0])
        return own(rows, keys, *rest)

    monkeypatch.setattr(neighbours, "over_runs", watched)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    monkeypatch.setattr(neighbours, "CELL", 40)
    assert found(df, df) == whole and sizes[0] < 60


def test_small_tables_find_every_row(spark):
    for n in range(2, 7):
        vectors = np.random.default_rng(n).normal(size=(n, 64))
        vectors[-1] = -vectors[0]
        df = table(spark, list(enumerate(vectors)))
        got = found(df, df)
        assert {q: {v for v, _ in rows} for q, rows in got.items()} == {q: set(range(n)) - {q} for q in range(n)}
