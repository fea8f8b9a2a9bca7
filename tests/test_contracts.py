from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.contracts import (
    Contract, Rule, accepted, default_rules, rejected, run_counts, summarize)
from ledgerloom.sources.dead_letters import read_dead_letters, write_dead_letters
from ledgerloom.sources.samples import tx_events, tx_lineitem

D1, D2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def verdicts(df, contract=None):
    return {r.rule: r for r in (contract or Contract("test")).report(df).collect()}


def test_clean_records_pass(records):
    df = records(("0x71", D2, "solana", 0.75, "pending"), ("0x72", D1, "polygon", 4200.0, "confirmed"),
                 ("0x73", D1, "avalanche", 18.0, "failed"))
    summary = summarize(Contract("test").report(df), "test", D2).first()
    assert (summary.rules_passed, summary.rules_failed, summary.passed) == (6, 0, True)
    assert summary.failed_rules == [] and summary.failures == []
    assert (summary.total_records, summary.evaluated_at) == (3, D2)


def test_amounts_that_are_not_positive_fail(records):
    df = records(("0x74", D1, "bitcoin", -0.01, "confirmed"), ("0x75", D1, "bitcoin", 0.0, "failed"), ("0x76", D2, "bitcoin", 9.0, "failed"))
    found = verdicts(df)["amount_usd_positive"]
    assert not found.passed and found.details == {"invalid_count": 2.0, "pct": 66.667}
    failure = summarize(Contract("test").report(df), "test").first().failures
    assert [(f.rule, f.details["invalid_count"]) for f in failure] == [("amount_usd_positive", 2.0)]


def test_repeated_hashes_fail(records):
    df = records(*[("0x77", D1, "solana", float(n), "pending") for n in (3, 5, 8)], ("0x78", D2, "solana", 1.5, "failed"))
    found = verdicts(df)["transaction_hash_unique"]
    assert not found.passed and found.details == {"duplicate_count": 2.0}


def test_split(records):
    clean, bad, _ = Contract("test").split(records(
        ("0x79", D2, "arbitrum", 64.0, "pending"), ("0x7a", D1, "arbitrum", -7.5, "pending"), ("0x7b", D1, "polygon", 2.25, "failed")))
    assert ([r.transaction_hash for r in clean.collect()], bad.count()) == (["0x79", "0x7b"], 1)


def test_text_amounts(spark):
    df = spark.createDataFrame([("a", "12.5"), ("b", "twelve"), ("c", "-1"), ("d", None)], "transaction_hash string, amount_usd string")
    clean, bad, report = Contract("test").split(df)
    assert [tuple(r) for r in clean.collect()] == [("a", 12.5)]
    assert sorted(r.transaction_hash for r in bad.collect()) == ["b", "c", "d"]
    assert {r.rule: r for r in report.collect()}["amount_usd_positive"].details["invalid_count"] == 2.0


def test_split_covers_every_row_once(records):
    df = records(("a", D1, "x", float("nan"), None), (None, D1, "x", 1.0, "s"), ("b", None, "x", 1.0, "s"),
                 ("c", D1, "x", None, "s"), ("d", D1, "x", 0.0, "s"), ("e", D1, None, 1.0, None))
    clean, bad, _ = Contract("test").split(df)
    assert [r.transaction_hash for r in clean.collect()] == ["e"]
    assert bad.count() == 5
    counts = run_counts(df).first()
    assert (counts.raw_records, counts.clean_records, counts.rejected_records) == (6, 1, 5)
    assert counts.rejection_rate_pct == 83.333


def test_accepted_reaches_the_scan(spark, records, tmp_path):
    path = str(tmp_path / "tx")
    records(("a", D1, "ethereum", 1.0, "confirmed")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(accepted(df))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(amount_usd,0.0)" in plan and "IsNotNull(transaction_hash)" in plan


def test_text_timestamps(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "yesterday-ish")], "transaction_hash string, timestamp string")
    assert [r.transaction_hash for r in df.where(rejected(df)).collect()] == ["b"]
    assert [r.transaction_hash for r in df.where(accepted(df)).collect()] == ["a"]
    assert verdicts(df)["timestamp_in_valid_range"].passed


def test_missing_columns(spark):
    found = verdicts(spark.createDataFrame([(1,)], "other int"))
    assert {k: v.passed for k, v in found.items()} == {
        "no_nulls_in_key_columns": True, "amount_positive": False, "timestamp_range": False,
        "status_values": True, "hash_uniqueness": False, "chain_values": True}
    assert found["amount_positive"].note == "column missing"
    assert found["chain_values"].note == "column not present"


def test_empty_input_passes(records):
    df = records(("a", D1, "ethereum", 1.0, "confirmed")).where("false")
    found = verdicts(df)
    assert all(r.passed for r in found.values())
    assert found["amount_usd_positive"].details["pct"] == 0.0
    assert run_counts(df).first().rejection_rate_pct == 0.0


def test_nulls_in_enums_are_invalid_but_not_rejected(records):
    df = records(("a", D1, None, 1.0, None))
    found = verdicts(df)
    assert not found["status_valid_enum"].passed and not found["chain_valid_enum"].passed
    assert df.where(rejected(df)).isEmpty()


def test_time_range_is_about_now(records):
    df = records(("a", datetime(2014, 12, 31), "ethereum", 1.0, "confirmed"), ("b", D2, "ethereum", 1.0, "confirmed"))
    found = verdicts(df, Contract("test", default_rules(D1)))["timestamp_in_valid_range"]
    assert found.details == {"future": 1.0, "too_old": 1.0} and not found.passed


def test_added_rules(records):
    df = records(("a", D1, "ethereum", 1.0, "confirmed"), ("b", D1, "ethereum", 3.0, "confirmed"))
    small = Rule("amount_below_2", ["amount_usd"], lambda have: {"over": F.count_if(F.col("amount_usd") >= 2)},
                 lambda have: ["over"], ("amount_below_2", True, ""))

    def one_row(rows):
        return rows.agg(F.count("*").alias("n")).select(
            F.lit("has_one_row").alias("rule"), (F.col("n") == 1).alias("passed"),
            F.create_map(F.lit("rows"), F.col("n").cast("double")).alias("details"), F.lit("").alias("note"))

    report = Contract("test").add_rule(small).add_rule(one_row).report(df).orderBy("position").collect()
    assert [r.rule for r in report[-2:]] == ["amount_below_2", "has_one_row"]
    assert [r.passed for r in report[-2:]] == [False, False]
    assert len(report) == 8


@pytest.mark.parametrize("view, rows, bad, surplus", [(tx_events, 1000, 38, 20), (tx_lineitem, 6000, 0, 1401)])
def test_sample_counts(spark, sf, view, rows, bad, surplus):
    df = view(spark, sf)
    counts = run_counts(df).first()
    assert (counts.raw_records, counts.rejected_records) == (rows, bad)
    assert verdicts(df)["transaction_hash_unique"].details["duplicate_count"] == surplus


def test_dead_letters_are_kept_per_batch_and_replayable(spark, records, tmp_path):
    root = str(tmp_path / "dead")
    a, b = records(("a", D1, "x", -1.0, "s")), records(("b", D1, "x", -1.0, "s"), ("c", D1, "x", -1.0, "s"))
    first = write_dead_letters(a, root, "one", "b1")
    assert first != write_dead_letters(b, root, "one", "b2")
    write_dead_letters(b, root, "one", "b2")
    rows = read_dead_letters(spark, root).groupBy("source", "batch_id").count().collect()
    assert {(r.source, r.batch_id): r["count"] for r in rows} == {("one", "b1"): 1, ("one", "b2"): 2}


def test_dead_letters_of_different_types_are_read_together(spark, tmp_path):
    root = str(tmp_path / "dead")
    write_dead_letters(spark.createDataFrame([("a", -1.5)], "transaction_hash string, amount_usd double"), root, "one", "20240101")
    write_dead_letters(spark.createDataFrame([("b", "none", 3)], "transaction_hash string, amount_usd string, extra int"), root, "one", "20240102")
    rows = {r.transaction_hash: r for r in read_dead_letters(spark, root).collect()}
    assert (rows["a"].amount_usd, rows["a"].batch_id) == (-1.5, "20240101")
    assert rows["b"].amount_usd is None and rows["b"].payload == {"transaction_hash": "b", "amount_usd": "none", "extra": "3"}
