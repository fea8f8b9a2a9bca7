"""Aggregates over a time frame that ends at the row, e.g. the last seven days.

Two plans give the same values. Groups of few rows use Spark's RANGE windows, which recompute
the frame for each row. Once a group is dense that costs rows x frame, so frames become running
aggregates: n rows cost n log n whatever the frame. Both work in doubles and take nothing back
from a total, so which plan a group gets does not show in its values. Groups too large for one
task are swept in chunks. Each group of a table takes the plan that suits its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.scalars import DAY, HOUR, micros
from ledgerloom.operators.chunks import ChunkPlan, add_earlier, combine, deviation, null_spread, plan_chunks, running_totals
from ledgerloom.operators.dedup import total_order
from ledgerloom.operators.rolling import as_list, in_group
from ledgerloom.schema import ENTITY, TIME
from ledgerloom.session import stage

FRAMES = {"1h": HOUR, "24h": DAY, "7d": 7 * DAY}
DENSE_GROUP = 2_000
ROWS_PER_TASK = 100_000      # every pass of a sweep sorts its rows once more, all in one task
KINDS = ("count", "sum", "mean", "max", "cv", "distinct")


@dataclass(frozen=True)
class Sliding:
    """One output column: ``kind`` of ``value`` over the ``span`` microseconds before a row.

    ``count`` counts non-null values, ``cv`` is sample deviation over mean, ``distinct`` counts
    different non-null values.
    """

    name: str
    kind: str
    value: str
    span: int

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown sliding aggregate {self.kind!r}")


def sliding(df: DataFrame, wanted: list[Sliding], group: str | list[str] = ENTITY,
            time: str = TIME, plan: ChunkPlan | None = None, dense: int = DENSE_GROUP) -> DataFrame:
    """Add the wanted columns. Frames include both ends and all rows of equal time."""
    group = as_list(group)
    plan = plan or plan_chunks(df, group, total_order(df, time))
    if plan.cuts is None and plan.largest <= dense:
        return _windows(df, wanted, group, time, plan)
    return _sweep(df, wanted, group, time, plan, dense)


def rolling_range(df: DataFrame, group: str | list[str] = ENTITY, amount: str = "amount_usd",
                  time: str = TIME, frames: dict[str, int] = FRAMES,
                  plan: ChunkPlan | None = None, dense: int = DENSE_GROUP) -> DataFrame:
    """Count, sum and mean per time frame, named like the feature catalog."""
    return sliding(df, range_columns(amount, time, frames), group, time, plan, dense)


def range_columns(amount: str = "amount_usd", time: str = TIME,
                  frames: dict[str, int] = FRAMES) -> list[Sliding]:
    return [Sliding(f"{prefix}_{label}", kind, value, span)
            for label, span in frames.items()
            for prefix, kind, value in [("txn_count", "count", time), ("amount_sum", "sum", amount),
                                        ("amount_mean", "mean", amount)]]


def _windows(df: DataFrame, wanted: list[Sliding], group: list[str], time: str, plan: ChunkPlan) -> DataFrame:
    out = _range_windows(plan.assign(df).withColumn("_at", micros(time)), wanted, group)
    return _finish(out, df, wanted, group)


def _range_windows(rows: DataFrame, wanted: list[Sliding], group: list[str]) -> DataFrame:
    spec = Window.partitionBy(*group, "_chunk").orderBy("_at")
    built = {}
    for s in wanted:
        frame, x = spec.rangeBetween(-s.span, 0), F.col(s.value)
        if s.kind == "cv":
            value = F.try_divide(F.stddev_samp(x).over(frame), F.avg(x).over(frame))
        elif s.kind == "distinct":
            value = F.size(F.collect_set(x).over(frame)).cast("bigint")
        else:
            value = {"count": F.count, "sum": F.sum, "mean": F.avg, "max": F.max}[s.kind](x).over(frame)
        built[s.name] = value
    return rows.withColumns(built)


def _finish(out: DataFrame, df: DataFrame, wanted: list[Sliding], group: list[str]) -> DataFrame:
    """Rows without a group or time are outside every frame."""
    names = [s.name for s in wanted]
    kept = [c for c in df.columns if c not in names]
    return out.select(*kept, *[
        in_group(group, F.when(F.col("_at").isNotNull(), F.col(n))).alias(n) for n in names])


# -- sweep ---------------------------------------------------------------------------------
#
# Counts are swept: a row adds one when it happens and takes it back when it leaves the frame,
# in whole numbers. Everything else is merged, never taken back: time is divided into slots as
# long as the frame, so a frame is the end of one slot and the start of the next. Each row
# leaves an echo one frame later, in the next slot; the frame's part in the earlier slot is
# then the running aggregate of the echoes from the far end.
#
# Groups that fit one task carry their rows through all passes after one exchange. For cut
# groups only the values move, in chunks of time: all frames are one table of marks with the
# frame as part of the key, written once and merged in one pass (counts too, as sums of ones),
# and the results of each instant are joined back to the rows of the instant.

SWEPT = ("count", "distinct")


def _sweep(df: DataFrame, wanted: list[Sliding], group: list[str], time: str, plan: ChunkPlan, dense: int) -> DataFrame:
    base = plan.assign(df.withColumn("_at", micros(time)), by_time=True)
    swept, merged = [s for s in wanted if s.kind in SWEPT], [s for s in wanted if s.kind not in SWEPT]
    spans = sorted({s.span for s in merged})
    changes = _changes(swept)
    distinct = sorted({v for m, v, _ in changes if m == "d"})
    cut = plan.cuts is not None
    # All windows below are partitioned by these columns and others, so none of them moves rows again.
    out = (base.where(~F.col("_cut")) if cut else base).repartition(*_parts_for(df, plan), *group, "_chunk")
    sparse = None
    if dense > 0:  # each group takes the plan that suits it, after the same exchange
        sized = out.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*group, "_chunk")))
        few = sized.where(F.col("_size") <= dense)
        sparse = _range_windows(few.select(*[c for c in out.columns if c not in {s.name for s in wanted}]), wanted, group)
        out = sized.where(F.col("_size") > dense).drop("_size")
    for value in distinct:
        out = _next_seen(out, value, group)
    if swept:
        out = _carried_counts(out, swept, changes, df.columns, group)
    for i, span in enumerate(spans):
        done = [x.name for x in [*swept, *[m for m in merged if m.span in spans[:i]]]]
        out = _carried_merges(out, [m for m in merged if m.span == span], span, [c for c in df.columns if c not in done] + done, group)
    out = out.select(*_with_names(df, wanted), "_at")
    if sparse is not None:
        out = out.unionByName(sparse.select(*_with_names(df, wanted), "_at"))
    if cut:
        hot = base.where("_cut")
        rows = hot.select(*[c for c in df.columns if c not in {s.name for s in wanted}], "_at")
        followed_up = [s for s in wanted if s.kind == "distinct"]
        summed = [s for s in wanted if s.kind != "distinct"]
        parts, points = [], _by_instant(plan)
        if followed_up:
            followed = hot
            for value in distinct:
                followed = _next_seen(followed, value, group, hot)
            parts.append(_instant_counts(followed, followed_up, _changes(followed_up), group, points))
        if summed:
            parts.append(_instant_merges(hot, summed, group, points))
        results = parts[0]
        for part in parts[1:]:  # every part has all instants of rows
            results = results.join(part, [*group, "_at"])
        # One join with the rows, so that the adaptive skew join can split a crowded instant.
        rows = rows.join(results, [*group, "_at"], "left")
        out = out.unionByName(rows.select(*_with_names(df, wanted), "_at"))
    return _finish(out, df, wanted, group)


def _parts_for(df: DataFrame, plan: ChunkPlan) -> list[int]:
    """Number of tasks of a sweep where the session's own would give each too many rows; left to the session otherwise."""
    needed = -(-plan.rows // ROWS_PER_TASK)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [max(needed, usual)] if needed > 1 else []


def _with_names(df: DataFrame, wanted: list[Sliding]) -> list[str]:
    names = [s.name for s in wanted]
    return [c for c in df.columns if c not in names] + names


def _changes(sums: list[Sliding]) -> dict[tuple[str, str, int], str]:
    """One running change per (c or d, value, span), shared by the columns that need it."""
    changes: dict[tuple[str, str, int], str] = {}
    for s in sums:
        changes.setdefault((s.kind[0], s.value, s.span), f"_d{len(changes)}")
    return changes


def _events(changes: dict, payload: Column | None = None, empty: Column | None = None) -> Column:
    """A row's entry and, per frame, its exit: structs of (row,) time and changes."""
    def amount(key, sign: int) -> Column:
        return F.when(F.col(key[1]).isNotNull() & F.col("_at").isNotNull(), F.lit(sign).cast("bigint"))

    def event(at: Column, signed: dict, body: Column | None) -> Column:
        # No change is NULL rather than 0: sums skip it.
        fields = [signed.get(k, F.lit(None).cast("bigint")).alias(n) for k, n in changes.items()]
        return F.struct(*([] if body is None else [body.alias("_row")]), at.alias("_at"), *fields)

    events = [event(F.col("_at"), {k: amount(k, 1) for k in changes}, payload)]
    for span in sorted({k[2] for k in changes if k[0] != "d"}):
        gone = {k: amount(k, -1) for k in changes if k[0] != "d" and k[2] == span}
        events.append(event(F.col("_at") + span + 1, gone, empty))
    for k in changes:
        if k[0] == "d":  # a value leaves when it expires or when its next occurrence takes over
            until = F.least(F.col("_at") + k[2] + 1, F.col(f"_next_{k[1]}"))
            events.append(event(until, {k: amount(k, -1)}, empty))
    return F.array(*events)


def _payload(rows: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    body = F.struct(*[F.col(c) for c in columns]) if columns else F.struct(F.lit(True).alias("_none"))
    return body, F.lit(None).cast(rows.select(body.alias("r")).schema["r"].dataType)


def _carried_counts(rows: DataFrame, swept: list[Sliding], changes: dict, columns: list[str],
                    group: list[str]) -> DataFrame:
    body, empty = _payload(rows, [c for c in columns if c not in group])
    # The group keeps its columns, so that the rows count as partitioned by them all the way.
    events = rows.select(*group, "_chunk", F.inline(_events(changes, body, empty)))
    found = running_totals(events, group, [F.col("_at").asc()], {n: ("sum", F.col(n)) for n in changes.values()},
                           cut=False, peers=True)
    return (found.where(F.col("_row").isNotNull()).select(*group, "_chunk", "_at", "_row.*", *changes.values())
            .withColumns(_counts(swept, changes)).drop(*changes.values(), "_none"))


def _instant_counts(hot: DataFrame, swept: list[Sliding], changes: dict, group: list[str],
                    points: ChunkPlan) -> DataFrame:
    instants = (hot.select(*group, "_last", F.inline(_events(changes)))
                .where(F.col("_at") <= micros("_last"))
                .groupBy(*group, "_at").agg(*[F.sum(n).alias(n) for n in changes.values()]))
    placed = stage(points.assign(instants), "instants")  # read for totals and for the sweep
    found = running_totals(placed, group, [F.col("_at").asc()],
                           {n: ("sum", F.col(n)) for n in changes.values()}, cut=True, peers=True)
    return found.select(*group, "_at", *[c.alias(n) for n, c in _counts(swept, changes).items()])


def _by_instant(plan: ChunkPlan) -> ChunkPlan:
    """The plan's cut points as microseconds of their time alone."""
    at = F.struct(F.col("_key.n0").alias("n0"), micros("_key.k0").alias("k0"))
    cuts = plan.cuts.select(*plan.group, at.alias("_key")).distinct()
    return ChunkPlan(plan.group, ["_at"], plan.largest, cuts, plan.most_cuts, plan.rows)


def _next_seen(rows: DataFrame, value: str, group: list[str], base: DataFrame | None = None) -> DataFrame:
    """Time at which the group's value occurs next, as ``_next_<value>``.

    With ``base``, the rows of cut groups, a (group, value) pair is followed chunk by chunk:
    each chunk gets one marker row with the first time of the pair's next chunk.
    """
    name = f"_next_{value}"
    pair = [*group, value, "_chunk"]
    unknown = F.col(value).isNull()
    spread = F.when(unknown, F.pmod(F.hash("_at"), F.lit(null_spread(rows)))).otherwise(0)
    follow = F.lead("_at").over(Window.partitionBy(*pair, spread).orderBy("_at"))
    if base is None:
        return rows.withColumn(name, follow)
    firsts = (base.where(~unknown).groupBy(*pair).agg(F.min("_at").alias("_at"))
              .withColumn("_chunk", F.lag("_chunk").over(Window.partitionBy(*group, value).orderBy("_chunk")))
              .where(F.col("_chunk").isNotNull())
              .withColumn("_marker", F.lit(True)))
    both = rows.withColumn("_marker", F.lit(False)).unionByName(firsts, allowMissingColumns=True)
    return both.withColumn(name, follow).where(~F.col("_marker")).drop("_marker")


def _counts(swept: list[Sliding], changes: dict) -> dict[str, Column]:
    return {s.name: F.coalesce(changes[(s.kind[0], s.value, s.span)], F.lit(0).cast("bigint")) for s in swept}


# -- merged aggregates ---------------------------------------------------------------------

def _parts(merged: list[Sliding]) -> dict[tuple[str, str], str]:
    """One running aggregate per (fold, value), shared by the columns that need it.

    A mean is sum over count, as in Spark's own average, unless the value's moments are there anyway.
    """
    folds = {"cv": ["moments"], "mean": ["sum", "count"]}
    spread = {s.value for s in merged if s.kind == "cv"}
    parts: dict[tuple[str, str], str] = {}
    for s in merged:
        for kind in ["moments"] if s.kind == "mean" and s.value in spread else folds.get(s.kind, [s.kind]):
            parts.setdefault((kind, s.value), f"_p{len(parts)}")
    return parts


def _merged(merged: list[Sliding], parts: dict[tuple[str, str], str]) -> dict[str, Column]:
    out = {}
    for s in merged:
        if s.kind in ("sum", "max"):
            out[s.name] = F.col(parts[(s.kind, s.value)])
            continue
        if s.kind == "count":
            out[s.name] = F.coalesce(parts[("count", s.value)], F.lit(0).cast("bigint"))
            continue
        if ("moments", s.value) not in parts:
            out[s.name] = F.try_divide(F.col(parts[("sum", s.value)]), F.col(parts[("count", s.value)]))
            continue
        moments = F.col(parts[("moments", s.value)])
        out[s.name] = moments["mean"] if s.kind == "mean" else F.try_divide(deviation(moments), moments["mean"])
    return out


def _slot(at: Column, span: Column) -> Column:
    return at - F.pmod(at, span)


def _mark(rows: DataFrame, parts: dict[tuple[str, str], str], span: int, echo: bool, *carried: Column) -> Column:
    """A row's values when it happens or, as their echo, one frame later."""
    kinds, fields = {"max": None, "count": "bigint"}, []
    for (kind, value), name in parts.items():
        there = F.lit(1).cast("bigint") if kind == "count" else F.col(value) if kind == "max" else F.col(value).cast("double")
        x = F.when(F.col("_at").isNotNull() & F.col(value).isNotNull(), there)
        nothing = F.lit(None).cast(kinds.get(kind, "double") or rows.schema[value].dataType)
        fields += [(nothing if echo else x).alias(f"{name}_now"), (x if echo else nothing).alias(f"{name}_echo")]
    return F.struct(*carried, (F.col("_at") + span if echo else F.col("_at")).alias("_at"), *fields)


def _two_sided(marks: DataFrame, parts: dict[tuple[str, str], str], keys: list[str], cut: bool) -> DataFrame:
    """Both sides of the frame within each slot of ``keys``, merged."""
    folds = {n: "sum" if kind == "count" else kind for (kind, _), n in parts.items()}
    begin = {f"{n}_begin": (kind, F.col(f"{n}_now")) for n, kind in folds.items()}
    rest = {f"{n}_rest": (kind, F.col(f"{n}_echo")) for n, kind in folds.items()}
    # Both sides run in the same tasks, and other chunks' totals of both are met in one join.
    both = running_totals(marks, keys, [F.col("_at").asc()], begin, cut=False, peers=True)
    both = running_totals(both, keys, [F.col("_at").desc()], rest, cut=False, peers=True)
    if cut:
        both = add_earlier(both, marks, keys, {**begin, **rest}, rest)
    return both.withColumns({n: combine(kind, F.col(f"{n}_rest"), F.col(f"{n}_begin")) for n, kind in folds.items()})


def _carried_merges(rows: DataFrame, merged: list[Sliding], span: int, columns: list[str], group: list[str]) -> DataFrame:
    parts = _parts(merged)
    body, empty = _payload(rows, [c for c in columns if c not in group])
    both = F.array(_mark(rows, parts, span, False, body.alias("_row")), _mark(rows, parts, span, True, empty.alias("_row")))
    marks = rows.select(*group, "_chunk", F.inline(both)).withColumn("_slot", _slot(F.col("_at"), F.lit(span)))
    return (_two_sided(marks, parts, [*group, "_slot"], cut=False).where(F.col("_row").isNotNull())
            .select(*group, "_chunk", "_at", "_row.*", *[c.alias(n) for n, c in _merged(merged, parts).items()]).drop("_none"))


def _instant_merges(hot: DataFrame, merged: list[Sliding], group: list[str], points: ChunkPlan) -> DataFrame:
    parts, last = _parts(merged), micros("_last")
    marks = hot.select(*group, "_last", F.inline(F.array(*[
        _mark(hot, parts, span, echo, F.lit(span).cast("bigint").alias("_span"), F.lit(not echo).alias("_own"))
        for span in sorted({s.span for s in merged}) for echo in (False, True)])))
    # Echoes past the group's last row count for the end of its slot, so they move there.
    marks = (marks.where(_slot(F.col("_at"), F.col("_span")) <= _slot(last, F.col("_span")))
             .withColumn("_at", F.least("_at", last)).drop("_last")
             .withColumn("_slot", _slot(F.col("_at"), F.col("_span"))))
    placed = stage(points.assign(marks), "instants")
    found = _two_sided(placed, parts, [*group, "_span", "_slot"], cut=True).where("_own")
    values = _merged(merged, parts)
    return found.groupBy(*group, "_at").agg(*[
        F.max(F.when(F.col("_span") == s.span, values[s.name])).alias(s.name) for s in merged])
