"""Ordered chunks: window work on groups that are too large for one task.

A window over a group runs in one task. Where one address (or day) may hold a third of all
rows, its rows are cut into consecutive chunks along the window order. Each chunk is a window
partition of its own, and what earlier chunks contribute to it is carried over from per-chunk
totals, which are small.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import stage

ROWS_PER_CHUNK = 2_000_000   # larger groups are cut
SAMPLES_PER_CHUNK = 32
POINTS_PER_PAGE = 32         # cut points that one row is compared with at a time
CHUNKS_PER_BLOCK = 100       # chunk totals that are merged one after the other


def null_spread(df: DataFrame) -> int:
    """Parts that rows without a group are spread over: as many as a shuffle has partitions, times four."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class ChunkPlan:
    """Cut points of the oversized groups of one DataFrame; ``cuts`` is None if there are none.

    A plan also fits any subset of the rows it was measured on, never later rows. ``rows`` is the
    number of those in groups that are not cut. ``cuts`` has a
    row per point with its ``_key`` and, unless dropped, the group's ``_last`` time. Points stay
    in the shared folder, in sorted pages; the pages of a group with many are found through pages
    of their first points. ``placed`` rows have their ``_chunk`` already, so that windows one after
    the other are partitioned by the same column.
    """

    group: list[str]
    order: list[str]
    largest: int = 0
    cuts: DataFrame | None = None
    most_cuts: int = 0
    rows: int = 0
    placed: bool = False

    def _known(self) -> Column:
        known = F.lit(True)
        for c in self.group:
            known = known & F.col(c).isNotNull()
        return known

    @cached_property
    def pages(self) -> list[DataFrame]:
        return self._pages(self.cuts)

    @cached_property
    def time_pages(self) -> list[DataFrame]:
        """Pages of the same points by the first order column alone."""
        return self._pages(self.cuts.withColumn("_key", F.struct("_key.n0", "_key.k0")).distinct())

    def _pages(self, points: DataFrame) -> list[DataFrame]:
        """Pages of points, the widest level first; the last level holds all points."""
        def paged(df: DataFrame, *more: str) -> DataFrame:
            return (df.groupBy(*self.group, (F.floor(F.col("_i") / POINTS_PER_PAGE)).cast("int").alias("_page"), *more)
                    .agg(F.sort_array(F.collect_list("_key")).alias("_points")))

        more = [c for c in points.columns if c not in (*self.group, "_key")]
        numbered = points.withColumn("_i", F.row_number().over(Window.partitionBy(*self.group).orderBy("_key")) - 1)
        levels = [stage(paged(numbered, *more), "pages")]
        width = 1  # pages of the lowest level below one entry
        while width * POINTS_PER_PAGE < self.most_cuts:
            below = levels[-1].where(F.col("_page") % width == 0).select(
                *self.group, (F.col("_page") / width).cast("int").alias("_i"), F.col("_points")[0].alias("_key"))
            # The first page below a page needs no point.
            levels.insert(0, stage(paged(below.where(F.col("_i") % POINTS_PER_PAGE != 0)), "pages"))
            width *= POINTS_PER_PAGE
        return levels

    def assign(self, df: DataFrame, by_time: bool = False) -> DataFrame:
        """Add ``_chunk`` (0 for groups that are not cut) and, if any group is cut, ``_cut``.

        ``by_time`` compares the first order column only, which keeps rows of equal time in
        one chunk. Rows with a null group belong to no group: they are only spread out.
        """
        if self.placed:
            return df
        spread = F.pmod(F.xxhash64(*self.order), F.lit(null_spread(df))).cast("int")
        if self.cuts is None:
            return df.withColumn("_chunk", F.when(self._known(), F.lit(0)).otherwise(spread))
        levels, key = (self.time_pages, order_key(self.order[:1])) if by_time else (self.pages, order_key(self.order))
        out, at = df.withColumn("_page", F.when(self._known(), F.lit(0)).otherwise(-1 - spread)), [*self.group, "_page"]
        place = F.col("_page") * POINTS_PER_PAGE + F.coalesce(_position("_points", key, POINTS_PER_PAGE), F.lit(0))
        for points in levels[:-1]:  # a point per page of points: a thirtieth of them
            out = out.join(F.broadcast(points), at, "left").withColumn(
                "_page", F.when(F.col("_page") < 0, F.col("_page")).otherwise(place)).drop("_points")
        return out.join(levels[-1], at, "left").withColumns({
            "_chunk": F.when(F.col("_page") < 0, -1 - F.col("_page")).when(F.col("_points").isNotNull(), place).otherwise(0),
            "_cut": F.col("_points").isNotNull(),
        }).drop("_points", "_page")


def order_key(order: list[str]) -> Column:
    """Struct that compares as the rows of ``order`` sort: first column nulls last."""
    first = F.col(order[0])
    return F.struct(first.isNull().alias("n0"), first.alias("k0"),
                    *[F.col(c).alias(f"k{i}") for i, c in enumerate(order[1:], 1)])


def _position(points: str, key: Column, most: int) -> Column:
    """Number of cut points <= key: a binary search written as a fold over falling steps."""
    steps = [1 << i for i in range(max(most, 1).bit_length() - 1, -1, -1)]

    def advance(at, step):
        return F.when(F.get(F.col(points), at + step - 1) <= key, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def plan_chunks(df: DataFrame, group: str | list[str], order: list[str],
                rows_per_chunk: int = ROWS_PER_CHUNK) -> ChunkPlan:
    """Measure group sizes and cut the oversized ones at sampled quantiles of their order.

    The size pass reads only the group columns and combines map-side. No cut point is taken
    unless a group is oversized, so ordinary data pays for that one narrow aggregate. One
    small cut point per ``rows_per_chunk`` rows of oversized groups is written to the shared
    folder. Sampling only places the cuts; results do not depend on where they fall.
    """
    group = [group] if isinstance(group, str) else list(group)
    known = df
    for c in group:
        known = known.where(F.col(c).isNotNull())
    sizes = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    limit = rows_per_chunk
    largest, rows, whole = (n or 0 for n in sizes.agg(
        F.max("_n"), F.sum("_n"), F.sum(F.when(F.col("_n") <= limit, F.col("_n")))).first())
    if largest <= limit:
        return ChunkPlan(group, order, largest, rows=rows)

    big = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max(order[0]).alias("_last")) \
        .where(F.col("_n") > limit).drop("_n")
    sample = (known.select(*group, order_key(order).alias("_key"))
              .join(F.broadcast(big), group)
              .sample(fraction=min(1.0, SAMPLES_PER_CHUNK / limit), seed=11))
    # A sort over all tasks; the id's lower bits count the rows of its partition.
    ranked = (sample.repartitionByRange(*group, "_key").sortWithinPartitions(*group, "_key")
              .withColumn("_i", F.monotonically_increasing_id()))
    cuts = stage(ranked.where(F.col("_i") % SAMPLES_PER_CHUNK == 0).select(*group, "_last", "_key").distinct(), "cuts")
    most = cuts.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if most is None:
        return ChunkPlan(group, order, largest, rows=rows)
    return ChunkPlan(group, order, largest, cuts, most, whole)


FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}
MOMENTS = "struct<n:bigint,mean:double,m2:double>"


def fold(kind: str, x: Column, over: Window | None = None) -> Column:
    """The aggregate of a kind. ``moments`` are count, mean and squared deviations from the mean."""
    place = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    if kind != "moments":
        return place(FOLDS[kind](x))
    v = x.cast("double")
    n = place(F.count(v))
    return F.struct(n.alias("n"), place(F.avg(v)).alias("mean"), (place(F.var_pop(v)) * n).alias("m2"))


def combine(kind: str, a: Column, b: Column) -> Column:
    """Merge two partial aggregates; NULL is the aggregate of no rows. Nothing is subtracted from a total."""
    if kind == "sum":
        return F.coalesce(a + b, a, b)
    if kind == "moments":
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + apart * (b["n"] / n)).alias("mean"),
                        (a["m2"] + b["m2"] + apart * apart * (a["n"] * (b["n"] / n))).alias("m2"))
        return F.when(b.isNull() | (b["n"] == 0), a).when(a.isNull() | (a["n"] == 0), b).otherwise(both)
    return (F.greatest if kind == "max" else F.least)(a, b)


def deviation(moments: Column) -> Column:
    """Sample standard deviation; NULL below two values."""
    return F.when(moments["n"] > 1, F.sqrt(moments["m2"] / (moments["n"] - 1)))


def running_totals(df: DataFrame, keys: list[str], order: list[Column],
                   totals: dict[str, tuple[str, Column]], cut: bool, peers: bool = False,
                   backward: bool = False, base: DataFrame | None = None) -> DataFrame:
    """Running sum, max, min or moments of each key along ``order``, computed per ``_chunk``.

    ``totals`` maps an output name to (kind, value). ``peers`` includes all rows of equal
    order. ``backward`` states that ``order`` descends, so that later chunks come first.
    Chunk totals are taken from ``base`` if ``df`` is the same rows with columns added at
    some cost.
    """
    frame = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    frame = (frame.rangeBetween if peers else frame.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({name: fold(kind, x, frame) for name, (kind, x) in totals.items()})
    return add_earlier(local, df if base is None else base, keys, totals, totals if backward else ()) if cut else local


def add_earlier(local: DataFrame, base: DataFrame, keys: list[str], totals: dict[str, tuple[str, Column]],
                backward: Collection[str] = ()) -> DataFrame:
    """Totals that run within each chunk, merged with those of the chunks before it; after it for names in ``backward``."""
    pieces = base.groupBy(*keys, "_chunk").agg(*[fold(kind, x).alias(name) for name, (kind, x) in totals.items()])

    def earlier(kind: str, name: str) -> Column:
        before = (Window.partitionBy(*keys)
                  .orderBy(F.col("_chunk").desc() if name in backward else F.col("_chunk").asc())
                  .rowsBetween(Window.unboundedPreceding, -1))
        return F.col(name) if kind == "moments" else FOLDS[kind](name).over(before)

    carried = pieces.select(*keys, "_chunk", *[
        earlier(kind, name).alias(f"_before_{name}") for name, (kind, _) in totals.items()])
    for back in (False, True):
        moments = [f"_before_{name}" for name, (kind, _) in totals.items() if kind == "moments" and (name in backward) == back]
        if moments:
            carried = _merged_before(carried, keys, moments, back)
    # The window left the rows partitioned by these join keys: only the totals move.
    return (local.join(carried, [*keys, "_chunk"], "left")
            .withColumns({name: combine(kind, F.col(name), F.col(f"_before_{name}"))
                          for name, (kind, _) in totals.items()})
            .drop(*[f"_before_{name}" for name in totals]))


def _merged_before(pieces: DataFrame, keys: list[str], names: list[str], backward: bool) -> DataFrame:
    """The moments of each chunk replaced by those of all earlier chunks of the key, merged.

    Merged one after the other they would cost a key's chunks squared: chunks are merged within
    blocks, blocks within blocks of blocks, and those along the key.
    """
    chunk = F.col("_chunk").desc() if backward else F.col("_chunk").asc()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(chunk)) - 1
    inner, outer = F.floor(F.col("_nth") / CHUNKS_PER_BLOCK), F.floor(F.col("_nth") / CHUNKS_PER_BLOCK ** 2)
    out = pieces.withColumn("_nth", nth).withColumns({"_block1": inner, "_block2": outer})
    full = [None, (F.col("_nth") + 1) % CHUNKS_PER_BLOCK == 0, (F.col("_nth") + 1) % CHUNKS_PER_BLOCK ** 2 == 0]
    whole = {n: F.col(n) for n in names}
    for level, within in enumerate((["_block2", "_block1"], ["_block2"], [])):
        # Blocks count with their last chunk.
        before = Window.partitionBy(*keys, *within).orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"{n}_{level}": F.aggregate(
            F.collect_list(whole[n] if level == 0 else F.when(full[level], whole[n])).over(before),
            F.lit(None).cast(MOMENTS), lambda a, b: combine("moments", a, b)) for n in names})
        out = out.withColumns({f"{n}_whole": combine("moments", F.col(f"{n}_{level}"), whole[n]) for n in names})
        whole = {n: F.col(f"{n}_whole") for n in names}
    result = {n: combine("moments", F.col(f"{n}_2"), combine("moments", F.col(f"{n}_1"), F.col(f"{n}_0"))) for n in names}
    return out.withColumns(result).select(*pieces.columns)
