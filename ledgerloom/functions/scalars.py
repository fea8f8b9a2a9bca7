"""Scalar expressions used by more than one operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MICROS = 1_000_000
HOUR = 3600 * MICROS
DAY = 24 * HOUR


def micros(ts: str | Column) -> Column:
    """Timestamp as microseconds; exact because sessions run in UTC."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def clean_double(name: str) -> Column:
    """NaN carries no meaning of its own in the records: treat it as NULL."""
    return F.nanvl(F.col(name), F.lit(None).cast("double"))


def invalid_member(column: Column, allowed: list[str]) -> Column:
    """True for values outside ``allowed``; a null is outside as well. Never NULL."""
    return ~F.coalesce(column.isin(allowed), F.lit(False))


def add_time_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Calendar parts and the day and hour partition labels."""
    at = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        at = F.to_timestamp_ntz(at)
    return df.withColumns({
        "year": F.year(at),
        "month": F.month(at),
        "day": F.dayofmonth(at),
        "hour": F.hour(at),
        "date_partition": F.date_format(at, "yyyy-MM-dd"),
        "hour_partition": F.date_format(at, "yyyy-MM-dd-HH"),
    })


def add_amount_columns(df: DataFrame, amount: str = "amount_usd", fee: str = "gas_fee_usd") -> DataFrame:
    """Log amount, fee share and total cost."""
    a, f = F.col(amount), F.col(fee)
    return df.withColumns({
        "amount_log": F.log1p(a),
        "fee_ratio": F.try_divide(f, a + F.lit(1e-6)),
        "total_cost_usd": a + f,
    })


def only_confirmed(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status) == "confirmed")


def iso_text(c: str | Column) -> Column:
    """A timestamp as ISO 8601 text, with six digits of a second's fraction if it has one."""
    at = F.col(c) if isinstance(c, str) else c
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(at == F.date_trunc("second", at), whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
