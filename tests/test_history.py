"""What is carried over time: entity state, keys seen before, features as of each event."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.asof import asof_join
from ledgerloom.operators.features import Prior, Thresholds, add_features
from ledgerloom.plans.entity_state import EntityState, counts_of, facts_of, merge_counts, merge_facts
from ledgerloom.plans.jobs import LedgerJob
from ledgerloom.plans.seen_keys import SeenKeys, key_filter, merge_filters
from ledgerloom.plans.snapshots import SnapshotTable
from ledgerloom.session import scratch_dir
from ledgerloom.sources.samples import tx_events
from ledgerloom.sources.windows import SourceConfig

DAY0 = datetime(2024, 1, 1)
LOADED = """transaction_hash string, block_number bigint, timestamp timestamp_ntz, chain string, from_address string, to_address string,
    amount_usd double, gas_fee_usd double, token_symbol string, tx_type string, status string, _source string"""


def tx(i, at, address="a", amount=10.0, chain="ethereum", status="confirmed", key=None):
    return (key or f"0x{i}", i, at, chain, address, "b", amount, 1.0, "ETH", "transfer", status, "s")


# -- as-of join ----------------------------------------------------------------------------

def brute_asof(rows, history, max_age=None):
    out = []
    for key, at, n in rows:
        known = [h for h in history if h[0] is not None and h[0] == key and h[1] is not None and at is not None and h[1] <= at]
        best = max(known, key=lambda h: (h[1], h[2])) if known else None
        if best is not None and max_age is not None and best[1] < at - max_age:
            best = None
        out.append((key, at, n, best[2] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_chunk", [7, 1_000_000])
@pytest.mark.parametrize("max_age", [None, timedelta(minutes=20)])
def test_asof_join_equals_brute_force(spark, per_chunk, max_age):
    rng = random.Random(4)
    keys = ["hot"] * 12 + ["x", "y", None]
    when = lambda: rng.choice([None] + [DAY0 + timedelta(minutes=rng.randint(0, 200)) for _ in range(9)])
    rows = [(rng.choice(keys), when(), i) for i in range(300)] + [("hot", DAY0, 0)] * 3
    history = [(rng.choice(keys), when(), float(i)) for i in range(200)]
    left = spark.createDataFrame(rows, "k string, t timestamp_ntz, n int")
    right = spark.createDataFrame(history, "k string, h timestamp_ntz, v double")
    found = asof_join(left, {"g": right}, "k", "t", "h", max_age, per_chunk)
    assert found.columns == ["k", "t", "n", "v"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_asof(rows, history, max_age)


def test_asof_join_of_several_histories_costs_one_exchange(spark):
    left = spark.createDataFrame([("e", DAY0, 1)], "k string, t timestamp_ntz, v int")
    right = spark.createDataFrame([("e", DAY0, 2), ("e", DAY0 + timedelta(seconds=1), 3)], "k string, t timestamp_ntz, v int")
    found = asof_join(left, {"a": right, "b": right.withColumnRenamed("v", "w")}, "k", "t", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert found.collect() == [("e", DAY0, 1, 2, 2)] and found.columns == ["k", "t", "v", "a_v", "w"]


def test_asof_join_with_empty_sides(spark):
    left = spark.createDataFrame([("e", DAY0, 1)], "k string, t timestamp_ntz, n int")
    right = spark.createDataFrame([], "k string, t timestamp_ntz, v double")
    assert asof_join(left, {"g": right}, "k", "t", "t").collect() == [("e", DAY0, 1, None)]
    assert asof_join(left.limit(0), {"g": right}, "k", "t", "t").collect() == []
    assert asof_join(left, {}, "k", "t", "t").collect() == [("e", DAY0, 1)]


# -- entity state --------------------------------------------------------------------------

def test_parts_merge_to_the_whole(spark, sf):
    rows = tx_events(spark, sf).where("timestamp IS NOT NULL")
    parts = [rows.where(f"block_number % 3 = {k}") for k in range(3)]
    merged = merge_facts(facts_of(parts[0]).unionByName(facts_of(parts[1])).unionByName(facts_of(parts[2])))
    whole = {r.from_address: r for r in facts_of(rows).collect()}
    for r in merged.collect():
        w = whole.pop(r.from_address)
        assert (r.first_time, r.last_time, r.moments.n) == (w.first_time, w.last_time, w.moments.n)
        assert r.moments.mean == pytest.approx(w.moments.mean) and r.moments.m2 == pytest.approx(w.moments.m2)
    assert not whole
    counts = merge_counts(counts_of(parts[0]).unionByName(counts_of(parts[1])).unionByName(counts_of(parts[2])))
    assert counts.exceptAll(counts_of(rows).select(*counts.columns)).isEmpty() and counts.count() == counts_of(rows).count()


def test_state_before_a_batch_is_the_same_after_it_is_recorded(spark):
    state = EntityState(spark, scratch_dir(spark, "state"), merge_every=2)
    days = [DAY0 + timedelta(days=d) for d in range(5)]
    batches = [spark.createDataFrame([tx(d, days[d], amount=float(d)), tx(d + 10, days[d], address=f"a{d}")], LOADED) for d in range(4)]
    entities = spark.createDataFrame([("a",), ("a0",), ("none",)], "from_address string")
    for d, rows in enumerate(batches):
        state.record(f"b{d}", rows, days[d + 1])
        state.record(f"b{d}", rows, days[d + 1])

    def known(batch, start, rows=batches[0].limit(0)):
        facts, counts = state.before(batch, start, entities, rows)
        return sorted((r.from_address, r.first_time, r.last_time, r.moments.n) for r in facts.collect()), counts.where("name = 'preferred_chain' AND from_address = 'a'").collect()

    assert known("b0", days[0]) == ([], [])
    assert known("b3", days[3]) == ([("a", days[0], days[2], 3), ("a0", days[0], days[0], 1)], [("a", "preferred_chain", "ethereum", 3)])
    assert known("new", days[4])[0][0] == ("a", days[0], days[3], 4)
    # A window before others that are loaded: from the table's rows.
    every = batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3])
    assert known("late", days[2], every) == ([("a", days[0], days[1], 2), ("a0", days[0], days[0], 1)], [("a", "preferred_chain", "ethereum", 2)])


def test_a_second_run_knows_what_the_first_has_loaded(spark):
    """Rows on 1 and 2 January and on 1 March, loaded in two runs."""
    inbox, root = scratch_dir(spark, "landed"), scratch_dir(spark, "job")
    march = datetime(2024, 3, 1, 12)
    spark.createDataFrame([tx(1, DAY0), tx(2, DAY0 + timedelta(days=1), amount=30.0), tx(3, march, amount=50.0)], LOADED).write.parquet(inbox)
    job = LedgerJob(spark, [SourceConfig("all", inbox)], root, all_features=True)
    job.run(DAY0, DAY0 + timedelta(days=10))
    job.run(datetime(2024, 3, 1), datetime(2024, 3, 2))
    store = {g: spark.read.parquet(f"{root}/features/groups/{g}/data").where(F.col("timestamp") == march).first()
             for g in ("behavioral", "risk_signals", "amount_statistics")}
    assert store["risk_signals"].dormant_account_flag and not store["risk_signals"].new_address_flag
    assert (store["behavioral"].days_since_first_txn, store["behavioral"].days_since_last_txn, store["behavioral"].account_age_days) == (60, 59, 61)
    assert store["amount_statistics"].amount_zscore == pytest.approx((50 - 30) / 20)


def test_prior_facts_equal_features_over_all_rows(spark, sf):
    rows = tx_events(spark, sf).where("transaction_hash IS NOT NULL AND timestamp IS NOT NULL AND amount_usd > 0")
    cut, end = datetime(2024, 1, 16), datetime(2024, 2, 1)
    groups = ["behavioral", "risk_signals"]
    limits = Thresholds(dormant_days=3, new_account_hours=48)
    old, new = rows.where(F.col("timestamp") < cut), rows.withColumn("_fresh", F.col("timestamp") >= cut).where(F.col("timestamp") >= cut - timedelta(days=7))
    later = add_features(new, groups, as_of=end, limits=limits, prior=Prior(facts_of(old), counts_of(old), "_fresh")).where("_fresh").drop("_fresh")
    whole = add_features(rows, groups, as_of=end, limits=limits).where(F.col("timestamp") >= cut)
    assert later.select(*whole.columns).exceptAll(whole).isEmpty() and later.count() == whole.count() > 0


# -- keys seen before ----------------------------------------------------------------------

def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def seen(spark, **options):
    table = SnapshotTable(spark, scratch_dir(spark, "table"))
    return table, SeenKeys(spark, scratch_dir(spark, "keys"), table, "key", **options)


def test_no_loaded_key_passes_and_few_others_are_looked_up(spark):
    table, known = seen(spark, blocks=4, merge_every=2)
    for part in range(4):
        table.write(keys(spark, [f"k{part}-{i}" for i in range(1000)]))
        known.catch_up()
    asked = keys(spark, [f"k{part}-{i}" for part in range(4) for i in range(0, 1000, 100)] + [f"new-{i}" for i in range(5000)] + ["k0-0"] * 50)
    fresh, looked_up, found = known.split(asked)
    assert sorted(r.key for r in fresh.collect()) == sorted(f"new-{i}" for i in range(5000))
    assert found == 40 and looked_up - found < 100


def test_saturated_filters_stay_exact(spark):
    table, known = seen(spark, blocks=1)
    table.write(keys(spark, [f"k{i}" for i in range(60_000)]))
    fresh, looked_up, found = known.split(keys(spark, ["k5", "new-1", "new-2", None]))
    assert sorted(r.key or "" for r in fresh.collect()) == ["", "new-1", "new-2"] and found == 1 <= looked_up


def test_versions_without_a_filter_are_caught_up(spark):
    table, known = seen(spark)
    table.write(keys(spark, ["a"]))
    table.write(keys(spark, ["b"]))      # committed, and the run failed before its filter
    fresh, _, found = known.split(keys(spark, ["a", "b", "c"]))
    assert [r.key for r in fresh.collect()] == ["c"] and found == 2
    assert SeenKeys(spark, known.filters.root, table, "key").filters.version == 2


def test_an_empty_table_has_seen_nothing(spark):
    _, known = seen(spark)
    fresh, looked_up, found = known.split(keys(spark, ["a", "a", None]))
    assert fresh.count() == 3 and (looked_up, found) == (0, 0)


def test_filters_merge_to_the_filter_of_all_keys(spark):
    a, b = keys(spark, ["x", "y"]), keys(spark, ["y", "z", None])
    merged = merge_filters(key_filter(a, "key", 8).unionByName(key_filter(b, "key", 8)))
    whole = key_filter(a.unionByName(b), "key", 8)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_a_replayed_window_adds_nothing_and_repeats_are_counted(spark):
    inbox, root = scratch_dir(spark, "landed"), scratch_dir(spark, "job")
    rows = [tx(1, DAY0), tx(2, DAY0), tx(3, DAY0 + timedelta(days=1), key="0x1"), tx(4, DAY0 + timedelta(days=1)),
            tx(5, DAY0, key="0x9", status="failed"), tx(6, DAY0 + timedelta(days=1), key="0x9")]
    spark.createDataFrame(rows, LOADED).write.parquet(inbox)
    job = LedgerJob(spark, [SourceConfig("all", inbox)], root, unique=True)
    job.run(DAY0, DAY0 + timedelta(days=1))
    for _ in range(2):
        run = job.run(DAY0 + timedelta(days=1), DAY0 + timedelta(days=2))
    # A hash that was never stored, as its first row had failed, is loaded.
    assert sorted(r.transaction_hash for r in job.table.read().collect()) == ["0x1", "0x2", "0x4", "0x9"]
    assert "hashes_repeated" not in run["metrics"]
    assert [r.metrics.get("hashes_repeated") for r in job.runs().orderBy("run_id").collect()] == [0.0, 1.0, None]
