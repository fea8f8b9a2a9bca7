"""Groups cut into very many chunks."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import chunks
from ledgerloom.operators.chunks import MOMENTS, plan_chunks


def hot_rows(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("a"), F.col("id") % 7)).when(F.col("id") % 51 != 0, F.lit("hot")).alias("from_address"),
        F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id div 3)").alias("timestamp"),
        F.col("id").alias("block_number"), F.col("id").cast("string").alias("transaction_hash"))


def test_points_that_travel_with_a_row_are_few(spark):
    """Each row meets pages of bounded size, however many points its group has, and chunks stay whole ranges of the order."""
    order = ["timestamp", "block_number", "transaction_hash"]
    df = hot_rows(spark, 60_000)
    plan = plan_chunks(df, "from_address", order, rows_per_chunk=20)
    assert plan.most_cuts > chunks.POINTS_PER_PAGE ** 2  # more than two levels of pages
    for levels in (plan.pages, plan.time_pages):
        assert len(levels) == 3
        for pages in levels:
            assert pages.agg(F.max(F.size("_points"))).first()[0] <= chunks.POINTS_PER_PAGE
    placed = plan.assign(df)
    assert placed.count() == 60_000 and placed.where("from_address is null").where("_cut").isEmpty()
    spans = (placed.where("from_address is not null").groupBy("from_address", "_chunk")
             .agg(F.count("*").alias("n"), F.min("block_number").alias("lo"), F.max("block_number").alias("hi")).collect())
    assert max(r["n"] for r in spans) < 100
    for address in {r["from_address"] for r in spans}:
        runs = sorted((r["_chunk"], r["lo"], r["hi"]) for r in spans if r["from_address"] == address)
        assert all(a[2] < b[1] for a, b in zip(runs, runs[1:]))
    by_time = plan.assign(df, by_time=True).where("from_address = 'hot'")
    assert by_time.groupBy("timestamp").agg(F.count_distinct("_chunk").alias("n")).where("n > 1").isEmpty()


@pytest.mark.parametrize("backward", [False, True])
def test_moments_before_a_chunk_are_merged_in_blocks(spark, backward, monkeypatch):
    """A chunk reads a list of at most a block's totals per level, not of all chunks before it."""
    monkeypatch.setattr(chunks, "CHUNKS_PER_BLOCK", 4)
    n = 150
    pieces = spark.range(n).select(F.lit("k").alias("key"), F.col("id").cast("int").alias("_chunk"), F.when(F.col("id") % 11 != 0, F.struct(
        F.lit(1).cast("bigint").alias("n"), (F.col("id") * 1.5).alias("mean"), F.lit(0.0).alias("m2"))).cast(MOMENTS).alias("m"))
    found = {r["_chunk"]: r["m"] for r in chunks._merged_before(pieces, ["key"], ["m"], backward).collect()}
    assert len(found) == n
    for chunk, m in found.items():
        values = [i * 1.5 for i in range(n) if i % 11 and (i > chunk if backward else i < chunk)]
        if not values:
            assert m is None
            continue
        mean = math.fsum(values) / len(values)
        assert (m.n, m.mean, m.m2) == (len(values), pytest.approx(mean), pytest.approx(math.fsum((v - mean) ** 2 for v in values), abs=1e-6))
