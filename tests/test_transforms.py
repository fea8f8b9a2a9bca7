import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import add_amount_columns, add_time_parts, only_confirmed
from ledgerloom.operators.chain import transform_chain
from ledgerloom.operators.dedup import deduplicate
from ledgerloom.operators.drift import evolve, normalize, resolve
from ledgerloom.operators.rolling import rolling_rows, window_label


def test_deduplicate_keeps_one_row_per_key(small):
    out = deduplicate(small, ["transaction_hash"])
    assert out.count() == 4
    assert out.select("transaction_hash").distinct().count() == 4


@pytest.mark.parametrize("keep, hour", [("last", 9), ("first", 6)])
def test_deduplicate_keep(small, keep, hour):
    row = deduplicate(small, ["transaction_hash"], keep).where("transaction_hash = '0x5e1'").first()
    assert row.timestamp.hour == hour


def test_deduplicate_none_drops_repeated_keys_and_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    assert [r.v for r in deduplicate(df, ["k"], False).collect()] == [3]
    assert deduplicate(df, ["k"], "last", ["v"]).where("k is null").first().v == 5


def test_deduplicate_is_idempotent_and_checks_keep(small):
    once = deduplicate(small, ["transaction_hash"])
    assert sorted(once.collect()) == sorted(deduplicate(once, ["transaction_hash"]).collect())
    with pytest.raises(ValueError):
        deduplicate(small, ["transaction_hash"], "any")


def test_deduplicate_limits_each_key_before_the_exchange(small):
    plan = deduplicate(small, ["transaction_hash"])._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_exchange


def test_filter_confirmed(small, spark):
    out = only_confirmed(small)
    assert out.count() == 3 and {r.status for r in out.collect()} == {"confirmed"}
    nulls = spark.createDataFrame([(None,), ("confirmed",)], "status string")
    assert only_confirmed(nulls).count() == 1


def test_time_parts(small):
    out = add_time_parts(small)
    row = out.orderBy("timestamp").collect()[1]
    assert (row.year, row.month, row.day, row.hour) == (2024, 3, 10, 7)
    assert row.date_partition == "2024-03-10" and row.hour_partition == "2024-03-10-07"


def test_time_parts_of_text(spark):
    out = add_time_parts(spark.createDataFrame([("2024-02-03 04:05:06",)], "timestamp string")).first()
    assert (out.day, out.hour, out.hour_partition) == (3, 4, "2024-02-03-04")


def test_amount_columns(small):
    rows = add_amount_columns(small).collect()
    assert all(r.amount_log >= 0 for r in rows)
    assert rows[0].amount_log == pytest.approx(math.log1p(12.5))
    assert rows[0].fee_ratio == pytest.approx(0.25 / (12.5 + 1e-6))
    assert rows[0].total_cost_usd == 12.75


def test_window_labels():
    assert [window_label(w) for w in (1, 23, 24, 168)] == ["1h", "23h", "1d", "7d"]


def test_rolling_rows_counts_everything_but_limits_sums(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"h{i}", start + timedelta(minutes=i), float(i), "a") for i in range(200)]
    df = spark.createDataFrame(rows, "transaction_hash string, timestamp timestamp_ntz, amount_usd double, from_address string")
    last = rolling_rows(df).where("transaction_hash = 'h199'").first()
    assert last.txn_count_1h == last.txn_count_1d == last.txn_count_7d == 200
    assert last.amount_sum_1h == 199.0
    assert last.amount_sum_1d == float(sum(range(176, 200)))
    assert last.amount_sum_7d == float(sum(range(32, 200)))
    assert last.amount_mean_7d == pytest.approx(sum(range(32, 200)) / 168)


def test_rolling_rows_skips_nulls_and_null_groups(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("a", start, None, "g"), ("b", start + timedelta(hours=1), 4.0, "g"), ("c", start, 9.0, None)],
        "transaction_hash string, timestamp timestamp_ntz, amount_usd double, from_address string")
    out = {r.transaction_hash: r for r in rolling_rows(df).collect()}
    assert out["a"].amount_sum_1h is None and out["a"].txn_count_1h == 1
    assert out["b"].amount_sum_1d == 4.0 and out["b"].amount_mean_1d == 4.0
    assert out["c"].txn_count_1h is None and out["c"].amount_sum_7d is None


def test_chain_lets_a_later_failed_copy_hide_a_confirmed_one(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("x", start, 1.0, 0.1, "confirmed", "g"), ("x", start + timedelta(hours=1), 1.0, 0.1, "failed", "g"),
         ("y", start, 2.0, 0.1, "confirmed", "g")],
        "transaction_hash string, timestamp timestamp_ntz, amount_usd double, gas_fee_usd double, status string, from_address string")
    assert [r.transaction_hash for r in transform_chain(df).collect()] == ["y"]
    with pytest.raises(ValueError):
        transform_chain(df, frame="days")


def test_chain_with_chunks_equals_chain_without(spark, sf):
    from ledgerloom.operators.contracts import accepted
    from ledgerloom.sources.samples import tx_events
    df = tx_events(spark, sf)
    df = df.where(accepted(df))
    for frame in ("rows", "range"):
        plain = transform_chain(df, frame)
        cut = transform_chain(df, frame, rows_per_chunk=15)
        rounded = [F.round(F.col(c) + 1e-9, 4).alias(c) if t == "double" else F.col(c) for c, t in plain.dtypes]
        assert plain.select(*rounded).exceptAll(cut.select(*rounded)).isEmpty()
        assert plain.count() == cut.count() == 571


def test_chain_uses_two_exchanges(spark, sf):
    from ledgerloom.sources.samples import tx_events
    plan = transform_chain(tx_events(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


# -- schema drift --------------------------------------------------------------------------

def test_evolve_fills_casts_and_keeps(spark):
    df = spark.createDataFrame([("1", "x", 5), (None, "7", 6)], "a string, b string, c int")
    out = evolve(df, {"a": "int64", "b": "int64", "c": "float64", "d": "string", "e": "bool", "f": "weird"})
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "string", "e": "boolean", "f": "string"}
    first = out.first()
    assert (first.a, first.b, first.c, first.d, first.e, first.f) == (1, "x", 5.0, "", False, None)
    with pytest.raises(ValueError):
        evolve(df, {"missing": "int64"}, fill_defaults=False)


def test_evolve_reads_no_data_for_certain_casts(spark):
    broken = spark.range(3).select(F.col("id").cast("int").alias("n"), F.raise_error(F.lit("read")).cast("string").alias("s"))
    out = evolve(broken, {"n": "int64", "s": "string"})
    assert dict(out.dtypes)["n"] == "bigint"


def test_type_defaults():
    assert [resolve(t)[1] for t in ("float64", "int64", "string", "object", "bool", "else?")] == [0.0, 0, "", None, False, None]


def test_normalize_orders_casts_and_turns_nan_to_null(spark):
    df = spark.createDataFrame([("1.5", "h", float("nan"), 1)], "amount_usd string, transaction_hash string, gas_fee_usd double, junk int")
    out = normalize(df)
    assert out.columns == ["transaction_hash", "amount_usd", "gas_fee_usd"]
    assert out.first() == ("h", 1.5, None)
