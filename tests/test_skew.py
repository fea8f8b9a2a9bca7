"""Plans for oversized groups against plain windows and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import DAY, HOUR
from ledgerloom.operators.chunks import plan_chunks
from ledgerloom.operators.features import add_features
from ledgerloom.operators.ranks import percent_rank
from ledgerloom.operators.rolling import history, rolling_rows
from ledgerloom.operators.sliding import Sliding, range_columns, sliding

ORDER = ["timestamp", "block_number", "transaction_hash"]
WANTED = [*range_columns(),
          Sliding("recipients", "distinct", "to_address", DAY), Sliding("chains", "distinct", "chain", DAY),
          Sliding("top", "max", "amount_usd", 7 * DAY), Sliding("top_hour", "max", "amount_usd", HOUR),
          Sliding("cv", "cv", "amount_usd", 7 * DAY)]


def make_rows(seed, n=500):
    """One address has most rows, a fifth of all rows share one instant, keys and values may be null."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        address = "hot" if pick.random() < 0.6 else None if pick.random() < 0.1 else f"a{pick.randint(0, 9)}"
        at = datetime(2024, 1, 1) + timedelta(minutes=pick.randint(0, 20 * 1440) // 7 * 7, microseconds=pick.choice([0, 0, 1]))
        if pick.random() < 0.2:
            at = datetime(2024, 1, 5)
        if pick.random() < 0.02:
            at = None
        rows.append((f"h{i}", i, at, pick.choice(["x", "y", None]), address, f"r{pick.randint(0, 30)}",
                     None if pick.random() < 0.05 else round(pick.random() * 1000, 2), "T", "confirmed", 0.5))
    return rows


@pytest.fixture(scope="module", params=[2])
def data(spark, request):
    rows = make_rows(request.param)
    df = spark.createDataFrame(rows, """transaction_hash string, block_number long, timestamp timestamp_ntz, chain string,
        from_address string, to_address string, amount_usd double, token_symbol string, status string, gas_fee_usd double""")
    return rows, df.repartition(4).cache()


def as_dict(df):
    return {r.transaction_hash: r.asDict() for r in df.collect()}


def assert_same(a, b):
    a, b = as_dict(a), as_dict(b)
    assert a.keys() == b.keys()
    for key, row in a.items():
        for name, x in row.items():
            y = b[key][name]
            if name == "_hist" and x and y and x.n:  # count, mean and squared deviations
                assert (x.n, x.mean, x.m2) == pytest.approx((y.n, y.mean, y.m2), rel=1e-9, abs=1e-9), (key, name)
                continue
            if isinstance(x, float) and isinstance(y, float):
                assert x == pytest.approx(y, abs=1e-6), (key, name)
            else:
                assert x == y, (key, name)


@pytest.fixture(scope="module", params=[25, 200])
def plans(data, request):
    whole = plan_chunks(data[1], "from_address", ORDER)
    cut = plan_chunks(data[1], "from_address", ORDER, rows_per_chunk=request.param)
    assert whole.cuts is None and cut.cuts is not None
    return whole, cut


def test_chunks_follow_the_order_and_cover_all_rows(data, plans):
    rows, df = data
    placed = plans[1].assign(df.where("from_address = 'hot' and timestamp is not null")).orderBy(*ORDER).collect()
    chunks = [r["_chunk"] for r in placed]
    assert chunks == sorted(chunks) and chunks[-1] > 0
    by_time = plans[1].assign(df.where("from_address = 'hot'"), by_time=True)
    assert by_time.groupBy("timestamp").agg(F.count_distinct("_chunk").alias("n")).where("n > 1").isEmpty()


def test_rolling_rows(data, plans):
    assert_same(rolling_rows(data[1], plan=plans[0]), rolling_rows(data[1], plan=plans[1]))


def test_history(data, plans):
    assert_same(history(data[1], plan=plans[0]), history(data[1], plan=plans[1]))


def test_sliding_dense(data, plans):
    assert_same(sliding(data[1], WANTED, plan=plans[0]), sliding(data[1], WANTED, plan=plans[0], dense=0))


def test_sliding_chunked(data, plans):
    assert_same(sliding(data[1], WANTED, plan=plans[0]), sliding(data[1], WANTED, plan=plans[1]))


def test_sliding_against_brute_force(data):
    rows, df = data
    found = as_dict(sliding(df, WANTED, dense=0))
    for h, _, at, _, address, *_ in rows[:150]:
        if at is None or address is None:
            assert found[h]["recipients"] is None and found[h]["txn_count_7d"] is None
            continue
        def frame(hours):
            return [r for r in rows if r[4] == address and r[2] is not None and at - timedelta(hours=hours) <= r[2] <= at]
        day, week = frame(24), [r[6] for r in frame(168) if r[6] is not None]
        assert found[h]["txn_count_24h"] == len(day)
        assert found[h]["recipients"] == len({r[5] for r in day})
        assert found[h]["chains"] == len({r[3] for r in day} - {None})
        assert found[h]["top"] == (max(week) if week else None)
        assert (found[h]["amount_sum_7d"] or 0) == pytest.approx(sum(week), abs=1e-6)


def test_rolling_rows_against_brute_force(data, plans):
    rows, df = data
    found = as_dict(rolling_rows(df, plan=plans[1]))
    hot = sorted((r for r in rows if r[4] == "hot"), key=lambda r: (r[2] is None, r[2] or datetime.max, r[1], r[0]))
    for i, r in enumerate(hot):
        last = [x[6] for x in hot[max(0, i - 167):i + 1] if x[6] is not None]
        assert found[r[0]]["txn_count_7d"] == sum(1 for x in hot[:i + 1] if x[2] is not None)
        assert (found[r[0]]["amount_sum_7d"] or 0) == pytest.approx(sum(last), abs=1e-6)


def test_percent_rank(data):
    df = data[1].withColumn("day", F.date_format("timestamp", "yyyy-MM"))
    plain = percent_rank(df, "day", "amount_usd", "share", plan_chunks(df, "day", ["amount_usd"]))
    plan = plan_chunks(df, "day", ["amount_usd"], rows_per_chunk=50)
    assert plan.cuts is not None
    assert_same(plain, percent_rank(df, "day", "amount_usd", "share", plan))


def test_all_features_chunked(spark, data, plans):
    df = data[1].where("timestamp is not null")
    labels = spark.createDataFrame([(f"r{i}", ["risky", "mixer", "exchange", "other"][i % 4], i / 10) for i in range(25)],
                                   "address string, category string, risk_score double")
    as_of = datetime(2024, 1, 15)
    day_plan = plan_chunks(df.withColumn("_day", F.date_format("timestamp", "yyyy-MM-dd")), "_day", ["amount_usd"], rows_per_chunk=20)
    plain = add_features(df, as_of=as_of, labels=labels, plan=plans[0])
    cut = add_features(df, as_of=as_of, labels=labels, plan=plans[1], day_plan=day_plan)
    assert len(plain.columns) == len(df.columns) + 41
    assert_same(plain, cut)


def test_no_cut_points_without_rows(data):
    assert plan_chunks(data[1].where("false"), "from_address", ORDER).cuts is None


def test_work_per_cut_point_is_linear(spark):
    """By-time cut points are made once: many of them cost a row no more than few."""
    import time
    df = spark.range(40_000).select(F.lit("hot").alias("from_address"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("timestamp"),
                                    F.col("id").alias("block_number"), F.col("id").cast("string").alias("transaction_hash"))
    seconds = {}
    for rows_per_chunk in (2000, 100):
        plan = plan_chunks(df, "from_address", ORDER, rows_per_chunk=rows_per_chunk)
        for _ in range(2):  # the second one counts
            began = time.perf_counter()
            chunks = plan.assign(df, by_time=True).select("_chunk").distinct().count()
            seconds[rows_per_chunk] = time.perf_counter() - began
        assert chunks > 40_000 / rows_per_chunk / 2
    assert seconds[100] < 4 * seconds[2000] + 2
