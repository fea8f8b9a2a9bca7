"""Aggregates over the last rows of a group, and running history along its row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.chunks import ChunkPlan, combine, plan_chunks, running_totals
from ledgerloom.operators.dedup import ascending, descending, total_order
from ledgerloom.schema import ENTITY, TIME

WINDOWS = [1, 24, 168]


def window_label(rows: int) -> str:
    return f"{rows}h" if rows < 24 else f"{rows // 24}d"


def as_list(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def in_group(group: list[str], value: Column) -> Column:
    """Rows with a null group belong to no group and get no value."""
    known = F.lit(True)
    for c in group:
        known = known & F.col(c).isNotNull()
    return F.when(known, value)


def rolling_rows(df: DataFrame, group: str | list[str] = ENTITY, amount: str = "amount_usd",
                 windows: list[int] = WINDOWS, time: str = TIME,
                 plan: ChunkPlan | None = None) -> DataFrame:
    """Per row and window length w: count of times so far, sum and mean of the last w rows.

    The count expands over the whole group for every label; only sums and means are limited
    to w rows. All columns share one exchange and one sort. Rows must be identified by time
    and tie-break columns (deduplicate first) for the order to be total.
    """
    group = as_list(group)
    order = total_order(df, time)
    plan = plan or plan_chunks(df, group, order)
    cut = plan.cuts is not None
    longest = max(windows)
    x = F.col(amount)

    spec = Window.partitionBy(*group, "_chunk").orderBy(*ascending(order))
    columns = {"_seen": F.count(time).over(spec.rowsBetween(Window.unboundedPreceding, 0))}
    if cut:
        columns["_nth"] = F.row_number().over(spec)
    for w in windows:
        frame = spec.rowsBetween(-(w - 1), 0)
        columns[f"_sum{w}"] = F.sum(x).over(frame)
        columns[f"_n{w}"] = F.count(x).over(frame)
    rows = plan.assign(df)
    out = rows.withColumns(columns)

    seen = F.col("_seen")
    sums = {w: F.col(f"_sum{w}") for w in windows}
    counts = {w: F.col(f"_n{w}") for w in windows}
    if cut:
        out = out.join(_carry(rows, group, order, x, time, longest), [*group, "_chunk"], "left")
        seen = seen + F.coalesce("_seen_before", F.lit(0))
        for w in windows:
            earlier = F.slice("_recent", F.lit(1), F.greatest(F.lit(w) - F.col("_nth"), F.lit(0)))
            known = F.filter(earlier, lambda v: v.isNotNull())
            reaches = (F.col("_nth") < w) & F.col("_recent").isNotNull()
            extra = F.when(reaches & (F.size(known) > 0), F.aggregate(known, F.lit(0.0), lambda a, v: a + v))
            sums[w] = combine("sum", sums[w], extra)
            counts[w] = counts[w] + F.when(reaches, F.size(known)).otherwise(0)

    result = {}
    for w in windows:
        label = window_label(w)
        result[f"txn_count_{label}"] = in_group(group, seen)
        result[f"amount_sum_{label}"] = in_group(group, sums[w])
        result[f"amount_mean_{label}"] = in_group(group, F.try_divide(sums[w], counts[w]))
    kept = [c for c in df.columns if c not in result]
    return out.select(*kept, *[c.alias(n) for n, c in result.items()])


def _carry(rows: DataFrame, group: list[str], order: list[str], x: Column, time: str,
           longest: int) -> DataFrame:
    """Per chunk of a cut group: times seen before it and the amounts of the rows before it.

    ``_recent`` holds at most ``longest - 1`` amounts, latest first. The rank limit trims
    every chunk to that many rows per map task before anything is exchanged. A chunk may be
    shorter than the longest window, so earlier chunks are taken by row distance, not by
    number.
    """
    keep = max(longest - 1, 1)
    keys = [*group, "_chunk"]
    hot = rows.where("_cut")
    last = Window.partitionBy(*keys).orderBy(*descending(order))
    tails = (hot.withColumn("_from_end", F.row_number().over(last))
             .where(F.col("_from_end") <= keep)
             .groupBy(*keys)
             .agg(F.sort_array(F.collect_list(F.struct("_from_end", x.cast("double").alias("v")))).alias("_tail")))
    sizes = hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.count(time).alias("_times"))
    chunks = sizes.join(tails, keys)

    along = Window.partitionBy(*group).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({
        "_seen_before": F.sum("_times").over(earlier),
        "_end": F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, 0)),
    })
    near = Window.partitionBy(*group).orderBy("_end").rangeBetween(-(keep - 1), 0)
    tails_so_far = F.flatten(F.reverse(F.collect_list(F.transform("_tail", lambda t: t["v"])).over(near)))
    return (chunks.withColumn("_through", F.slice(tails_so_far, 1, keep))
            .select(*keys, "_seen_before", F.lag("_through").over(along).alias("_recent")))


def history(df: DataFrame, group: str | list[str] = ENTITY, amount: str = "amount_usd",
            time: str = TIME, plan: ChunkPlan | None = None, base: DataFrame | None = None) -> DataFrame:
    """Running facts of each group up to and including the row.

    Adds ``_hist`` (count, mean and squared deviations of the amounts, merged from the pieces
    of a cut group), ``_first_time`` and ``_previous_time``. Chunk totals are taken from
    ``base`` if ``df`` is the same rows with columns added at some cost.
    """
    group = as_list(group)
    order = total_order(df, time)
    plan = plan or plan_chunks(df, group, order)
    cut = plan.cuts is not None
    x = F.col(amount)
    rows = plan.assign(df)
    source = plan.assign(base) if cut and base is not None else rows
    out = running_totals(rows, group, ascending(order), {
        "_hist": ("moments", x),
        "_first_time": ("min", F.col(time)),
    }, cut, base=source)
    along = Window.partitionBy(*group, "_chunk").orderBy(*ascending(order))
    out = out.withColumn("_previous_time", F.lag(time).over(along))
    if cut:
        ends = source.where("_cut").groupBy(*group, "_chunk").agg(
            F.when(F.count_if(F.col(time).isNull()) == 0, F.max(time)).alias("_last_time"))  # nulls come last
        before = ends.select(*group, "_chunk", F.lag("_last_time").over(
            Window.partitionBy(*group).orderBy("_chunk")).alias("_earlier_time"))
        out = out.withColumn("_nth", F.row_number().over(along))
        out = out.join(before, [*group, "_chunk"], "left").withColumn(
            "_previous_time",
            F.when(F.col("_nth") == 1, F.col("_earlier_time")).otherwise(F.col("_previous_time")))
    return out.select(*df.columns, *[
        in_group(group, F.col(c)).alias(c)
        for c in ["_hist", "_first_time", "_previous_time"]])
