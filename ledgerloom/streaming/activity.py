"""Activity of addresses on a stream: counts over sliding spans, and sessions that end in silence.

Both are event-time aggregations of Spark's own, so a hot address is combined map-side, and
state is kept per address and open window only: it is given up once the watermark, the latest
time seen less ``delay``, has passed the window. Rows that come later than that are dropped if
all windows of theirs are closed; rows without an address or time are dropped at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.schema import ENTITY, TIME


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    """Streams need zoned timestamps."""
    return (stream.where(F.col(ENTITY).isNotNull() & F.col(TIME).isNotNull())
            .withColumn(TIME, F.col(TIME).cast("timestamp")).withWatermark(TIME, delay))


def panes(stream: DataFrame, delay: str, pane: str = "1 hour") -> DataFrame:
    """(pane, address, n, amount, largest): what each address did in each pane of time."""
    return _timed(stream, delay).groupBy(F.window(TIME, pane).alias("pane"), ENTITY).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_usd").alias("amount"), F.max("amount_usd").alias("largest"))


def activity(stream: DataFrame, delay: str, span: str = "24 hours", pane: str = "1 hour", busy: int = 10, high_value: float = 1000.0) -> DataFrame:
    """Activity of each address over ``span``, pane by pane: (window_start, window_end, address, ...).

    Panes are made once and merged into the spans they belong to, so a row is aggregated once
    however many spans overlap. ``busy_flag`` marks spans with at least ``busy`` transactions.
    Rows appear when their span is closed.
    """
    merged = panes(stream, delay, pane).groupBy(F.window(F.window_time("pane"), span, pane).alias("span"), ENTITY).agg(
        F.sum("n").alias("txn_count"), F.sum("amount").alias("amount_sum"), F.max("largest").alias("max_single_txn"))
    return merged.select(
        F.col("span.start").cast("timestamp_ntz").alias("window_start"), F.col("span.end").cast("timestamp_ntz").alias("window_end"), ENTITY,
        "txn_count", "amount_sum", "max_single_txn", (F.col("txn_count") >= busy).alias("busy_flag"),
        (F.col("max_single_txn") > high_value).alias("high_value_flag"))


def sessions(stream: DataFrame, delay: str, silence: str) -> DataFrame:
    """(address, first_time, last_time, dormant_at, txn_count, amount_sum) of each session.

    A session ends when its address is silent for ``silence``: the row appears when the watermark
    passes that moment, which is when the address goes dormant. A transaction after it
    begins a new session, so every first transaction but an address's earliest ends a dormancy.
    """
    return _timed(stream, delay).groupBy(F.session_window(TIME, silence).alias("session"), ENTITY).agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("amount_usd").alias("amount_sum"), F.max(TIME).alias("last")).select(
        ENTITY, F.col("session.start").cast("timestamp_ntz").alias("first_time"), F.col("last").cast("timestamp_ntz").alias("last_time"),
        F.col("session.end").cast("timestamp_ntz").alias("dormant_at"), "txn_count", "amount_sum")
