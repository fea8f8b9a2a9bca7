"""How often features move the rows."""

import re
from datetime import datetime, timedelta

from ledgerloom.operators.features import add_features
from ledgerloom.operators.ranks import modes_per_group

MOVE = r"Exchange hashpartitioning\(from_address#\d+, _chunk#\d+"


def test_frames_and_history_of_an_entity_follow_one_exchange(spark):
    rows = [(f"a{i % 5}" if i % 11 else None, f"b{i % 3}", datetime(2024, 1, 1) + timedelta(hours=i), i, str(i), "c", "t", float(i), 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "from_address string, to_address string, timestamp timestamp_ntz, block_number long, transaction_hash string, chain string, token_symbol string, amount_usd double, gas_fee_usd double")
    out = add_features(df, ["transaction_velocity", "risk_signals"])
    assert len(re.findall(MOVE, out._jdf.queryExecution().executedPlan().toString())) == 1
    assert out.count() == 60 and "_chunk" not in out.columns
    every = add_features(df, as_of=datetime(2024, 2, 1))
    assert every.count() == 60 and every.where("from_address IS NULL AND preferred_chain IS NOT NULL").count() == 0


def test_counts_from_before_join_the_count(spark):
    new = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "g string, v string")
    before = spark.createDataFrame([("a", "m", "x", 3), ("b", "m", "z", 1), ("c", "m", "w", 2)], "g string, name string, value string, n bigint")
    out = modes_per_group(new, ["g"], {"m": "v"}, before)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(g#") == 2
    assert sorted(map(tuple, out.collect())) == [("a", "x"), ("b", "z"), ("c", "w")]
