"""Ranks and modes that hold up on large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.operators.chunks import ChunkPlan, plan_chunks, running_totals


def percent_rank(df: DataFrame, group: str, value: str, name: str, plan: ChunkPlan | None = None,
                 base: DataFrame | None = None) -> DataFrame:
    """Share of the group's other rows with a smaller value; nulls rank last.

    A group is often a whole day of data. Where one is too large for a task, equal values are
    counted first (map-side), ranks come from running counts over chunks of the value range,
    and rows look up their rank by value. Counts are taken from ``base`` if ``df`` is the
    same rows with columns added at some cost.
    """
    plan = plan or plan_chunks(df if base is None else base, group, [value])
    known, order = F.col(group).isNotNull(), [F.col(value).asc_nulls_last()]
    if plan.cuts is None:
        rank = F.percent_rank().over(Window.partitionBy(group, "_chunk").orderBy(*order))
        return plan.assign(df).withColumn(name, F.when(known, rank)).drop("_chunk")

    sizes = (plan.assign(df if base is None else base).where(known)
             .groupBy(group, "_chunk", value).agg(F.count(F.lit(1)).alias("_same")))
    ranked = running_totals(sizes, [group], order, {"_upto": ("sum", F.col("_same"))}, cut=True, peers=True)
    whole = (sizes.groupBy(group, "_chunk").agg(F.sum("_same").alias("_piece"))
             .withColumn("_all", F.sum("_piece").over(Window.partitionBy(group))))
    share = F.coalesce(F.try_divide(F.col("_upto") - F.col("_same"), F.col("_all") - 1), F.lit(0.0))
    ranks = ranked.join(whole, [group, "_chunk"]).select(
        F.col(group).alias("_g"), F.col(value).alias("_v"), share.alias(name))
    return df.join(ranks, (F.col(group) == F.col("_g")) & F.col(value).eqNullSafe(F.col("_v")),
                   "left").drop("_g", "_v")


def value_counts(df: DataFrame, group: list[str], columns: dict[str, str]) -> DataFrame:
    """(group, name, value, n): how often each non-null value of the columns occurs per group.

    ``columns`` maps names to columns. All are counted in one pass, combined map-side, so a
    hot group moves one row per value and task.
    """
    return _values(df, group, columns).groupBy(*group, "name", "value").agg(F.count(F.lit(1)).alias("n"))


def _values(df: DataFrame, group: list[str], columns: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("value")) for name, c in columns.items()])
    return df.select(*group, F.inline(pairs)).where(F.col("value").isNotNull())


def modes_per_group(df: DataFrame, group: list[str], columns: dict[str, str], more: DataFrame | None = None) -> DataFrame:
    """Most frequent non-null value of each text column per group, the larger one on a tie.

    ``more`` are counts of other rows of the groups, as ``value_counts`` makes them.
    """
    if more is None:
        counts = value_counts(df, group, columns)
    else:  # counted together: a union of two counts is not coalesced into fewer tasks
        ones = _values(df, group, columns).withColumn("n", F.lit(1).cast("bigint"))
        counts = ones.unionByName(more).groupBy(*group, "name", "value").agg(F.sum("n").alias("n"))
    return counts.groupBy(*group).agg(*[
        F.max_by("value", F.when(F.col("name") == name, F.struct("n", "value"))).alias(name)
        for name in columns])
