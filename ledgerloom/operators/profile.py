"""Mergeable profiles of batches, and drift between two of them.

A profile has one row per column: number of rows and nulls, least and greatest value, a KLL
sketch of a numeric column's distribution, and HyperLogLog and theta sketches of its distinct
values. Profiles of any batches merge to the profile of all their rows without reading a row
again, so they are kept with the batch's report. What they say is estimated: ranks of quantiles are off by at
most about 2.3 / k**0.9 of the rows for sketches of size k, distinct counts by a few times
1 / sqrt(2**size), and both are exact while a column has fewer values than the sketch holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

KLL_SIZE = 400          # ranks within about 1%
HLL_SIZE = 12           # 4,096 registers: about 2%
THETA_SIZE = 12         # 4,096 values: about 2%
SHARES = [0.1, 0.25, 0.5, 0.75, 0.9]
PROFILE = """column string, records bigint, nulls bigint, low double, high double, first string, last string,
             distribution binary, distinct binary, members binary"""


def profile(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, kll_size: int = KLL_SIZE) -> DataFrame:
    """One row per column (and per value of ``by``): one aggregate, combined map-side.

    Columns of numbers have ``low``, ``high`` and a distribution, others ``first`` and ``last``.
    """
    by = by or []
    found = []
    for c in columns or [c for c in df.columns if c not in by]:
        x, number = F.col(f"`{c}`"), isinstance(df.schema[c].dataType, T.NumericType)
        none = F.lit(None)
        parts = {
            "records": F.count(F.lit(1)), "nulls": F.count_if(x.isNull()),
            "low": F.min(x).cast("double") if number else none.cast("double"), "high": F.max(x).cast("double") if number else none.cast("double"),
            "first": none.cast("string") if number else F.min(x).cast("string"), "last": none.cast("string") if number else F.max(x).cast("string"),
            "distribution": F.kll_sketch_agg_double(x.cast("double"), F.lit(kll_size)) if number else none.cast("binary"),
            "distinct": F.hll_sketch_agg(x.cast("string"), HLL_SIZE), "members": F.theta_sketch_agg(x.cast("string"), THETA_SIZE)}
        found.append(F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in parts.items()]).alias(f"_p{len(found)}"))
    wide = df.groupBy(*by).agg(*found)
    return wide.select(*by, F.inline(F.array(*[F.col(f"_p{i}") for i in range(len(found))])))


def merge_profiles(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The profile of the rows of all parts."""
    return parts.groupBy(*(by or []), "column").agg(
        F.sum("records").alias("records"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.when(F.count("distribution") > 0, F.kll_merge_agg_double("distribution")).alias("distribution"),
        F.hll_union_agg("distinct").alias("distinct"), F.theta_union_agg("members").alias("members"))


def quantile(sketch: str, share: float) -> Column:
    """A quantile, null for a column without numbers."""
    filled = F.when(F.coalesce(F.kll_sketch_get_n_double(sketch), F.lit(0)) > 0, F.col(sketch))
    return F.when(filled.isNotNull(), F.kll_sketch_get_quantile_double(filled, F.lit(float(min(1.0, max(0.0, share))))))


def estimates(profiles: DataFrame, shares: list[float] = SHARES) -> DataFrame:
    """Profiles with their sketches read: distinct values and an array of quantiles."""
    return profiles.select(
        *[c for c in profiles.columns if c not in ("distribution", "distinct", "members")],
        F.hll_sketch_estimate("distinct").alias("distinct"), F.theta_sketch_estimate("members").alias("members"),
        F.array(*[quantile("distribution", p) for p in shares]).alias("quantiles"))


def drift(reference: DataFrame, current: DataFrame, shift: float = 0.05, nulls: float = 0.01, overlap: float = 0.5,
          shares: list[float] = SHARES) -> DataFrame:
    """One row per column of either profile: what moved by more than the limits.

    ``shifted``: a quantile of the current rows lies outside those of the reference at a share
    ``shift`` below and above. ``null_change`` is the change of the share of nulls, limited by
    ``nulls``. ``new_members`` is the number of values the reference doesn't have, and
    ``overlap`` the least share of all values that both must have; columns of numbers are not
    held to it. A column that only one side has has drifted.
    """
    a = reference.select("column", *[F.col(c).alias(f"_{c}") for c in ("records", "nulls", "distribution", "members")])
    both = current.join(a, "column", "full")
    shifted = F.lit(False)
    for p in shares:
        at = quantile("distribution", p)
        outside = (at < quantile("_distribution", p - shift)) | (at > quantile("_distribution", p + shift))
        shifted = shifted | F.coalesce(outside, F.lit(False))
    share = lambda side: F.try_divide(F.col(f"{side}nulls"), F.col(f"{side}records"))
    common = F.theta_sketch_estimate(F.theta_intersection("members", "_members"))
    all_values = F.theta_sketch_estimate(F.theta_union("members", "_members"))
    one_sided = F.col("records").isNull() | F.col("_records").isNull()
    out = both.select(
        "column", one_sided.alias("one_sided"), shifted.alias("shifted"), (share("") - share("_")).alias("null_change"),
        F.when(~one_sided, F.theta_sketch_estimate("members") - common).alias("new_members"),
        F.when(~one_sided & F.col("distribution").isNull(), F.try_divide(common, all_values)).alias("overlap"))
    kept = ~F.col("one_sided") & ~F.col("shifted") & (F.abs("null_change") <= nulls) & (F.coalesce("overlap", F.lit(1.0)) >= overlap)
    return out.withColumn("passed", F.coalesce(kept, F.lit(False)))


def stable_profile(reference: DataFrame, **limits) -> Callable[[DataFrame], DataFrame]:
    """A contract rule: the batch's profile has not drifted from ``reference``; details name the columns that have."""
    def no_drift(df: DataFrame) -> DataFrame:
        columns = [r.column for r in reference.select("column").collect()]
        found = drift(reference, profile(df, columns), **limits)
        moved = F.collect_list(F.when(~F.col("passed"), F.struct(F.col("column").alias("key"), F.lit(1.0).alias("value"))))
        return found.agg(moved.alias("moved")).select(
            F.lit("profile_stable").alias("rule"), (F.size("moved") == 0).alias("passed"),
            F.map_from_entries("moved").alias("details"), F.lit("").alias("note"))
    return no_drift
