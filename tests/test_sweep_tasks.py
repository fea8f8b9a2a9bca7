"""Tasks of a sweep hold a bounded number of rows."""

import re
from datetime import datetime, timedelta

from ledgerloom.operators import sliding
from ledgerloom.operators.sliding import rolling_range


def test_tasks_of_a_sweep_grow_with_the_rows(spark, monkeypatch):
    rows = [(f"a{i % 90}", datetime(2024, 1, 1) + timedelta(hours=i), i, str(i), float(i)) for i in range(1800)]
    df = spark.createDataFrame(rows, "from_address string, timestamp timestamp_ntz, block_number long, transaction_hash string, amount_usd double")
    names = [c for c in rolling_range(df).columns if c not in df.columns]
    usual = {r.block_number: [r[n] for n in names] for r in rolling_range(df, dense=0).collect()}
    monkeypatch.setattr(sliding, "ROWS_PER_TASK", 100, raising=False)
    out = rolling_range(df, dense=0)
    assert re.search(r"hashpartitioning\(from_address#\d+, _chunk#\d+, 18\), REPARTITION_BY_NUM", out._jdf.queryExecution().executedPlan().toString())
    assert {r.block_number: [r[n] for n in names] for r in out.collect()} == usual
