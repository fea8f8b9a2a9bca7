"""What frames over chunks cost: tasks for the rows that are not cut, one meeting with the totals of other chunks."""

from datetime import datetime, timedelta

from ledgerloom.operators.chunks import plan_chunks
from ledgerloom.operators.dedup import total_order
from ledgerloom.operators.sliding import rolling_range


def test_chunks_of_a_frame_carry_no_moments_for_means(spark):
    start = datetime(2024, 1, 1)
    rows = [("hot" if i % 4 else "small", start + timedelta(hours=i), i, str(i), i * 0.5 if i % 7 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "from_address string, timestamp timestamp_ntz, block_number long, transaction_hash string, amount_usd double")
    plan = plan_chunks(df, "from_address", total_order(df), 40)
    assert plan.cuts is not None and plan.rows == 30  # those of the small group
    out = rolling_range(df, plan=plan)
    assert "m2" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        near = [x[4] for x in rows if x[0] == r.from_address and timedelta(0) <= r.timestamp - x[1] <= timedelta(days=1) and x[4] is not None]
        assert abs((r.amount_mean_24h or 0.0) - (sum(near) / len(near) if near else 0.0)) < 1e-9
        assert (r.amount_mean_24h is None) == (not near)
