"""Point-in-time join: each row with the latest row of a history at or before its own time."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.chunks import ROWS_PER_CHUNK, plan_chunks, running_totals
from ledgerloom.operators.dedup import ascending
from ledgerloom.operators.rolling import in_group
from ledgerloom.schema import ENTITY, TIME
from ledgerloom.session import stage


def asof_join(rows: DataFrame, histories: dict[str, DataFrame], entity: str = ENTITY, time: str = TIME,
              history_time: str = TIME, max_age: timedelta | None = None,
              rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``rows`` with the columns of each history's latest row of the same entity at their time.

    All sides are united, so any number of histories costs one exchange and one sort, in which
    the latest row of each is carried forward as a running maximum of (time, columns). Entities
    too large for a task are cut into chunks along the time; what earlier chunks end with is
    carried over. Every row is kept once. Without an entity, a time, or an earlier row of the
    history at most ``max_age`` old, its columns are null. Of history rows of equal time the
    greatest counts, compared column by column; their columns must be comparable, so no maps.
    Columns whose name is taken are prefixed with the name of their history.
    """
    key, at = F.col(entity).alias("_entity"), F.col(time).alias("_at")
    # Of equal times the history comes first: it is known at that time.
    parts = [rows.select(key, at, F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))]
    taken, names, carried = set(rows.columns), {}, {}
    for i, (name, df) in enumerate(histories.items()):
        columns = [c for c in df.columns if c not in (entity, history_time)]
        names[i] = [c if c not in taken else f"{name}_{c}" for c in columns]
        taken.update(names[i])
        body = F.struct(F.col(history_time).alias("at"), *[F.col(f"`{c}`").alias(f"f{j}") for j, c in enumerate(columns)])
        parts.append(df.where(F.col(history_time).isNotNull() & F.col(entity).isNotNull()).select(
            F.col(entity).alias("_entity"), F.col(history_time).alias("_at"), F.lit(0).alias("_side"), body.alias(f"_h{i}")))
        carried[f"_known{i}"] = ("max", F.col(f"_h{i}"))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = ["_at", "_side"]
    plan = plan_chunks(united, "_entity", order, rows_per_chunk)
    if plan.cuts is not None:
        united = stage(united, "asof")  # chunk totals read it as well
    found = running_totals(plan.assign(united), ["_entity"], ascending(order), carried, plan.cuts is not None)
    found = found.where(F.col("_side") == 1)
    picks = []
    for i, columns in names.items():
        known = F.col(f"_known{i}")
        ok = F.col("_at").isNotNull() & known.isNotNull()
        if max_age is not None:
            ok = ok & (known["at"] >= F.col("_at") - F.lit(max_age))
        picks += [in_group(["_entity"], F.when(ok, known[f"f{j}"])).alias(c) for j, c in enumerate(columns)]
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns], *picks)
