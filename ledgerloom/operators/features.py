"""The catalog's features as columns on transaction rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scalars import DAY, add_amount_columns
from ledgerloom.operators.chunks import ChunkPlan, combine, deviation, plan_chunks
from ledgerloom.operators.dedup import total_order
from ledgerloom.operators.ranks import modes_per_group, percent_rank
from ledgerloom.operators.rolling import history
from ledgerloom.operators.sliding import DENSE_GROUP, Sliding, range_columns, sliding
from ledgerloom.schema import ENTITY, FEATURE_GROUPS, TIME
from ledgerloom.session import stage

WEEK = 7 * DAY                                                       # the longest frame of any feature
MODES = {"preferred_chain": "chain", "preferred_token": "token_symbol"}


@dataclass(frozen=True)
class Thresholds:
    """Limits of the flag features."""

    high_value: float = 1000.0
    rapid_seconds: int = 60
    dormant_days: int = 30
    new_account_hours: int = 24
    round_amount: float = 1000.0
    round_step: float = 100.0


@dataclass(frozen=True)
class Prior:
    """What is known of the entities from before the new rows.

    ``facts(entity, first_time, last_time, moments)`` has one row per entity, ``counts(entity,
    name, value, n)`` one per value of the columns with modes. ``fresh`` names a column that is
    true for the new rows. Others are there for frames and ranks only: they are in the facts.
    """

    facts: DataFrame
    counts: DataFrame
    fresh: str


def plan_days(df: DataFrame, **limits) -> ChunkPlan:
    """Chunk plan for ranks within a day."""
    return plan_chunks(_with_day(df), "_day", ["amount_usd"], **limits)


def add_features(df: DataFrame, groups: list[str] | None = None, as_of: datetime | None = None,
                 labels: DataFrame | None = None, limits: Thresholds = Thresholds(),
                 plan: ChunkPlan | None = None, day_plan: ChunkPlan | None = None,
                 dense: int = DENSE_GROUP, prior: Prior | None = None) -> DataFrame:
    """Add the features of the named catalog groups (all by default).

    All time frames are computed together. ``as_of`` fixes account ages and preferred values;
    ``labels(address, category, risk_score)`` is needed by the network group only and its
    features are skipped without it. With ``prior`` the facts of a lifetime go on from there;
    frames and ranks need their rows in ``df``. Plans may be measured on any superset of the rows, for
    instance on the raw table. With oversized groups the rows are staged first, since the
    chunked plans scan them more than once. Without, ranks are taken while rows are narrow, and all
    that is by entity then follows one exchange.
    """
    groups = list(FEATURE_GROUPS) if groups is None else groups
    unknown = set(groups) - set(FEATURE_GROUPS)
    if unknown:
        raise ValueError(f"unknown feature groups: {sorted(unknown)}")
    if labels is None:
        groups = [g for g in groups if g != "network"]
    plan = plan or plan_chunks(df, ENTITY, total_order(df))
    if "amount_statistics" in groups:
        day_plan = day_plan or plan_days(df)
    base = _attach_labels(df, labels) if "network" in groups else df
    if prior is not None:
        base = base.withColumn("_counted", F.when(F.col(prior.fresh), F.col("amount_usd")))
    if plan.cuts is not None or (day_plan is not None and day_plan.cuts is not None):
        base = stage(base, "features")
    out = base
    whole = plan.cuts is None and plan.largest <= dense
    if whole:
        if "amount_statistics" in groups:
            out = _day_ranks(out, base, day_plan)
        out, plan = plan.assign(out), replace(plan, placed=True)
    frames = _frames(groups)
    if frames:
        out = sliding(out, frames, ENTITY, TIME, plan, dense)
    if set(groups) & {"amount_statistics", "behavioral", "risk_signals"}:
        out = history(out, ENTITY, "amount_usd" if prior is None else "_counted", TIME, plan, base)
        if prior is not None:
            out = _after(out, prior, whole)
    if "behavioral" in groups:
        out = _behavioral(out, base, as_of, prior, whole)
    if "amount_statistics" in groups:
        out = _amount_statistics(out if whole else _day_ranks(out, base, day_plan))
    if "risk_signals" in groups:
        out = _risk_signals(out, limits)
    if "network" in groups:
        out = _network(out)
    wanted = [f for g in groups for f in FEATURE_GROUPS[g]]
    kept = [c for c in df.columns if c not in wanted]
    return out.select(*kept, *wanted)


def _join_entities(df: DataFrame, facts: DataFrame, placed: bool) -> DataFrame:
    """Add one row per entity. A hot entity can be split by the skew join; rows placed by entity stay where they are."""
    if not placed:
        return df.join(facts, ENTITY, "left")
    return df.join(facts.withColumn("_chunk", F.when(F.col(ENTITY).isNotNull(), 0)), [ENTITY, "_chunk"], "left")


def _after(df: DataFrame, prior: Prior, placed: bool) -> DataFrame:
    """Merge the facts from before into the running ones."""
    facts = prior.facts.select(ENTITY, F.struct("first_time", "last_time", "moments").alias("_before"))
    return _join_entities(df, facts, placed).withColumns({
        "_hist": combine("moments", F.col("_hist"), F.col("_before.moments")),
        "_first_time": F.least("_first_time", "_before.first_time"),
        "_previous_time": F.coalesce("_previous_time", "_before.last_time"),
    }).drop("_before")


def _with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("_day", F.date_format(TIME, "yyyy-MM-dd"))


def _frames(groups: list[str]) -> list[Sliding]:
    frames: dict[str, Sliding] = {}
    if "transaction_velocity" in groups:
        for s in range_columns():
            frames[s.name] = s
    if set(groups) & {"transaction_velocity", "risk_signals"}:
        frames["txn_count_24h"] = Sliding("txn_count_24h", "count", TIME, DAY)
        frames["unique_chains_24h"] = Sliding("unique_chains_24h", "distinct", "chain", DAY)
    if "transaction_velocity" in groups:
        frames["unique_recipients_24h"] = Sliding("unique_recipients_24h", "distinct", "to_address", DAY)
    if "amount_statistics" in groups:
        frames["amount_mean_7d"] = Sliding("amount_mean_7d", "mean", "amount_usd", WEEK)
        frames["max_single_txn_7d"] = Sliding("max_single_txn_7d", "max", "amount_usd", WEEK)
        frames["amount_cv_7d"] = Sliding("amount_cv_7d", "cv", "amount_usd", WEEK)
    if "network" in groups:
        for s in [Sliding("unique_counterparties_7d", "distinct", "to_address", WEEK),
                  Sliding("counterparty_risk_score_avg", "mean", "_risk", WEEK),
                  Sliding("_risky_7d", "count", "_risky", WEEK),
                  Sliding("_mixer_7d", "count", "_mixer", WEEK),
                  Sliding("_exchange_7d", "sum", "_exchange", WEEK),
                  Sliding("_volume_7d", "sum", "amount_usd", WEEK)]:
            frames[s.name] = s
    return list(frames.values())


def _hour() -> Column:
    return F.hour(TIME)


def _night() -> Column:
    return F.hour(TIME) < 6


def _day_ranks(df: DataFrame, base: DataFrame, day_plan: ChunkPlan) -> DataFrame:
    return percent_rank(_with_day(df), "_day", "amount_usd", "amount_percentile", day_plan, _with_day(base))


def _amount_statistics(df: DataFrame) -> DataFrame:
    amount, seen = F.col("amount_usd"), F.col("_hist")
    return add_amount_columns(df).withColumns({
        "amount_zscore": F.try_divide(amount - seen["mean"], deviation(seen)),
        "amount_momentum": F.try_divide(amount, F.col("amount_mean_7d")) - 1,
    })


def _behavioral(df: DataFrame, base: DataFrame, as_of: datetime | None, prior: Prior | None, placed: bool) -> DataFrame:
    at = F.col(TIME)
    until = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
    out = df.withColumns({
        "hour_of_day": _hour(),
        "day_of_week": F.weekday(at),
        "is_weekend": F.weekday(at) >= 5,
        "is_night": _night(),
        "days_since_first_txn": F.timestamp_diff("DAY", F.col("_first_time"), at),
        "days_since_last_txn": F.timestamp_diff("DAY", F.col("_previous_time"), at),
        "account_age_days": F.timestamp_diff("DAY", F.col("_first_time"), until),
    })
    known = base.where(at <= until)
    if prior is not None:
        known = known.where(prior.fresh)
    preferred = modes_per_group(known, [ENTITY], MODES, prior.counts if prior is not None else None)
    return _join_entities(out, preferred, placed)


def _risk_signals(df: DataFrame, limits: Thresholds) -> DataFrame:
    at, amount = F.col(TIME), F.col("amount_usd")
    gap = F.timestamp_diff("SECOND", F.col("_previous_time"), at)
    age = F.timestamp_diff("SECOND", F.col("_first_time"), at)
    high = amount > limits.high_value
    return df.withColumns({
        "velocity_x_amount": F.col("txn_count_24h") * amount,
        "cross_chain_activity": F.col("unique_chains_24h") > 1,
        "high_value_flag": high,
        "rapid_succession_flag": F.coalesce(gap < limits.rapid_seconds, F.lit(False)),
        "dormant_account_flag": F.coalesce(gap > limits.dormant_days * 86400, F.lit(False)),
        "new_address_flag": age < limits.new_account_hours * 3600,
        "large_round_amount_flag": (amount >= limits.round_amount) & (amount % limits.round_step == 0),
        "off_hours_large_txn": _night() & high,
    })


def _attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of the receiving address. Spark broadcasts the labels if they are small."""
    one = labels.groupBy(F.col("address").alias("to_address")).agg(
        F.max(F.struct("risk_score", "category")).alias("_label"))
    category = F.col("_label.category")
    return df.join(one, "to_address", "left").withColumns({
        "_risk": F.col("_label.risk_score"),
        "_risky": F.when(category == "risky", 1),
        "_mixer": F.when(category == "mixer", 1),
        "_exchange": F.when(category == "exchange", F.col("amount_usd")),
    }).drop("_label")


def _network(df: DataFrame) -> DataFrame:
    share = F.try_divide(F.coalesce("_exchange_7d", F.lit(0.0)), F.col("_volume_7d"))
    return df.withColumns({
        "known_risky_address": F.col("_risky_7d") > 0,
        "mixer_interaction": F.col("_mixer_7d") > 0,
        "exchange_volume_pct": 100.0 * share,
    })
