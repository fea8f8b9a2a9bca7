"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.schema import TIES, TIME


def total_order(df: DataFrame, time: str = TIME, ties: list[str] = TIES) -> list[str]:
    """The order columns that ``df`` has."""
    return [c for c in [time, *ties] if c in df.columns]


def ascending(order: list[str]) -> list[Column]:
    """Earliest first; rows without a time come last, ties order nulls first."""
    return [F.col(order[0]).asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in order[1:]]]


def descending(order: list[str]) -> list[Column]:
    """Exact reverse of :func:`ascending`."""
    return [F.col(order[0]).desc_nulls_first(), *[F.col(c).desc_nulls_last() for c in order[1:]]]


def deduplicate(df: DataFrame, keys: list[str], keep: str | bool = "last",
                order: list[str] | None = None) -> DataFrame:
    """Keep the last or first row of each key, or with ``keep=False`` only keys that occur once.

    Null keys equal each other. The rank limit lets Spark cut every key to one or two rows
    per map task before the exchange (WindowGroupLimit), so a key with many copies never
    reaches one task whole.
    """
    order = order or total_order(df) or keys
    if keep not in ("last", "first", False):
        raise ValueError(f"keep must be 'last', 'first' or False, not {keep!r}")
    by_key = Window.partitionBy(*keys)
    ranked = df.withColumn("_rank", F.row_number().over(
        by_key.orderBy(*(ascending(order) if keep == "first" else descending(order)))))
    if keep is False:
        pairs = ranked.where(F.col("_rank") <= 2)
        return (pairs.withColumn("_copies", F.count(F.lit(1)).over(by_key))
                .where(F.col("_copies") == 1).drop("_rank", "_copies"))
    return ranked.where(F.col("_rank") == 1).drop("_rank")
