"""Data contracts: rules evaluated in one aggregate, and the clean / rejected split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scalars import invalid_member
from ledgerloom.schema import CHAINS, EARLIEST_TIMESTAMP, KEY_COLUMNS, STATUSES

REPORT_COLUMNS = ["position", "rule", "passed", "details", "note", "total_records"]


@dataclass(frozen=True)
class Rule:
    """A rule made of aggregate columns.

    ``metrics`` maps metric names to aggregates over the checked rows; the rule passes when
    all metrics named in ``zero`` are 0. ``absent`` is used when no column of ``needs``
    exists: (rule name, passed, note).
    """

    name: str
    needs: list[str]
    metrics: Callable[[list[str]], dict[str, Column]]
    zero: Callable[[list[str]], list[str]]
    absent: tuple[str, bool, str]


# A rule that needs its own shuffle: DataFrame -> one row (rule, passed, details, note).
TableRule = Callable[[DataFrame], DataFrame]


def as_timestamp(df: DataFrame, name: str = "timestamp") -> Column:
    """The column as a timestamp; text that is not one becomes NULL."""
    if dict(df.dtypes)[name] == "string":
        return F.col(name).try_cast("timestamp_ntz")
    return F.col(name)


def as_amount(df: DataFrame, name: str = "amount_usd") -> Column:
    """The column as a number; text that is not one becomes NULL."""
    if dict(df.dtypes)[name] == "string":
        return F.col(name).try_cast("double")
    return F.col(name)


def key_nulls() -> Rule:
    return Rule(
        "no_nulls_in_key_columns", KEY_COLUMNS,
        lambda have: {c: F.count_if(F.col(c).isNull()) for c in have},
        lambda have: have,
        ("no_nulls_in_key_columns", True, ""),
    )


def amount_positive() -> Rule:
    # Text and number columns share one expression: a double casts to itself.
    amount = F.col("amount_usd").try_cast("double")
    invalid = F.count_if((amount <= 0) | (F.col("amount_usd").isNotNull() & amount.isNull()))
    share = F.round(100.0 * invalid / F.greatest(F.count(F.lit(1)), F.lit(1)), 3)
    return Rule(
        "amount_usd_positive", ["amount_usd"],
        lambda have: {"invalid_count": invalid, "pct": share},
        lambda have: ["invalid_count"],
        ("amount_positive", False, "column missing"),
    )


def time_range(now: datetime | None = None) -> Rule:
    # Text and timestamp columns share one expression: a timestamp casts to itself.
    at = F.col("timestamp").try_cast("timestamp_ntz")
    limit = F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz")
    first = F.lit(EARLIEST_TIMESTAMP).cast("timestamp_ntz")
    return Rule(
        "timestamp_in_valid_range", ["timestamp"],
        lambda have: {"future": F.count_if(at > limit), "too_old": F.count_if(at < first)},
        lambda have: ["future", "too_old"],
        ("timestamp_range", False, "column missing"),
    )


def allowed_values(name: str, column: str, allowed: list[str], absent: str) -> Rule:
    return Rule(
        name, [column],
        lambda have: {"invalid_count": F.count_if(invalid_member(F.col(column), allowed))},
        lambda have: ["invalid_count"],
        (absent, True, "column not present"),
    )


def hash_unique(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each hash; nulls form one group. Counts combine map-side."""
    if "transaction_hash" not in df.columns:
        return _verdict(df, "hash_uniqueness", False, "column missing")
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return (df.groupBy("transaction_hash").agg(F.count(F.lit(1)).alias("n"))
            .agg(surplus.alias("surplus"))
            .select(F.lit("transaction_hash_unique").alias("rule"),
                    (F.col("surplus") == 0).alias("passed"),
                    F.create_map(F.lit("duplicate_count"), F.col("surplus").cast("double")).alias("details"),
                    F.lit("").alias("note")))


def _verdict(df: DataFrame, rule: str, passed: bool, note: str) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(rule, passed, {}, note)], "rule string, passed boolean, details map<string,double>, note string")


def default_rules(now: datetime | None = None) -> list[Rule | TableRule]:
    """The six standard rules in report order."""
    return [
        key_nulls(),
        amount_positive(),
        time_range(now),
        allowed_values("status_valid_enum", "status", STATUSES, "status_values"),
        hash_unique,
        allowed_values("chain_valid_enum", "chain", CHAINS, "chain_values"),
    ]


def rejected(df: DataFrame) -> Column:
    """True for rows that must not reach the table. Never NULL, so the split is exact.

    Only amount, hash and time reject a row; status, chain, range and duplicate findings are
    reported without rejecting. NaN sorts above all numbers in Spark, hence its own test.
    """
    bad = F.lit(False)
    if "amount_usd" in df.columns:
        amount = as_amount(df)
        if dict(df.dtypes)["amount_usd"] in ("double", "float", "string"):
            bad = bad | F.coalesce(F.isnan(amount), F.lit(False))
        bad = bad | F.coalesce(amount <= 0, F.lit(True))
    if "transaction_hash" in df.columns:
        bad = bad | F.col("transaction_hash").isNull()
    if "timestamp" in df.columns:
        bad = bad | as_timestamp(df).isNull()
    return bad


def accepted(df: DataFrame) -> Column:
    """The rows that :func:`rejected` leaves, as plain conditions that reach the scan."""
    good = F.lit(True)
    if "amount_usd" in df.columns:
        good = good & (as_amount(df) > 0)
        if dict(df.dtypes)["amount_usd"] in ("double", "float", "string"):
            good = good & ~F.isnan(as_amount(df))
    if "transaction_hash" in df.columns:
        good = good & F.col("transaction_hash").isNotNull()
    if "timestamp" in df.columns:
        good = good & as_timestamp(df).isNotNull()
    return good


@dataclass
class Contract:
    """A named, ordered set of rules."""

    source: str
    rules: list[Rule | TableRule] = field(default_factory=default_rules)

    def add_rule(self, rule: Rule | TableRule) -> "Contract":
        self.rules.append(rule)
        return self

    def report(self, df: DataFrame) -> DataFrame:
        """One row per rule: position, rule, passed, details, note.

        All aggregate rules share one pass that reads only the columns they name; each table
        rule is one narrow aggregate of its own.
        """
        aggregates, cells, parts = [], [], []
        for position, rule in enumerate(self.rules):
            if not isinstance(rule, Rule):
                parts.append(rule(df).select(F.lit(position).alias("position"), *REPORT_COLUMNS[1:-1],
                                             F.lit(None).cast("bigint").alias("total_records")))
                continue
            have = [c for c in rule.needs if c in df.columns]
            metrics = rule.metrics(have) if have else {}
            names = {m: f"m{position}_{i}" for i, m in enumerate(metrics)}
            aggregates += [column.alias(names[m]) for m, column in metrics.items()]
            name, passed, note = (rule.name, None, "") if have else rule.absent
            verdict = F.lit(passed)
            if have:
                verdict = F.lit(True)
                for metric in rule.zero(have):
                    verdict = verdict & (F.col(names[metric]) == 0)
            details = [x for m in metrics for x in (F.lit(m), F.col(names[m]).cast("double"))]
            cells.append(F.struct(
                F.lit(position).alias("position"), F.lit(name).alias("rule"),
                verdict.alias("passed"),
                (F.create_map(*details) if details else F.create_map().cast("map<string,double>")).alias("details"),
                F.lit(note).alias("note"), F.col("_total").alias("total_records")))
        if cells:
            shared = df.agg(F.count(F.lit(1)).alias("_total"), *aggregates)
            parts.append(shared.select(F.inline(F.array(*cells))))
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Clean rows, rejected rows and the rule report.

        Clean rows have a number as amount and a timestamp as time, whatever they came as;
        rejected rows are left as they are.
        """
        clean, kinds = df.where(accepted(df)), dict(df.dtypes)
        if kinds.get("amount_usd") == "string":
            clean = clean.withColumn("amount_usd", as_amount(df))
        if kinds.get("timestamp") == "string":
            clean = clean.withColumn("timestamp", as_timestamp(df))
        return clean, df.where(rejected(df)), self.report(df)


def summarize(report: DataFrame, source: str, at: datetime | None = None) -> DataFrame:
    """Rule totals as one row, with the details of each failed rule; ``at`` is the time of the report."""
    # Maps have no order, their entries do.
    failed = F.when(~F.col("passed"), F.struct("position", "rule", F.map_entries("details").alias("details"), "note"))
    return report.agg(
        (F.lit(at) if at else F.current_timestamp()).cast("timestamp_ntz").alias("evaluated_at"),
        F.max("total_records").alias("total_records"),
        F.transform(F.sort_array(F.collect_list(failed)), lambda f: F.struct(
            f["rule"].alias("rule"), F.map_from_entries(f["details"]).alias("details"), f["note"].alias("note"))).alias("failures"),
        F.lit(source).alias("source"),
        F.count_if("passed").alias("rules_passed"),
        F.count_if(~F.col("passed")).alias("rules_failed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
        F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("rule")))).alias("failed_rules"),
    )


def count_columns(raw: DataFrame) -> list[Column]:
    """Aggregates of raw, clean and rejected rows with the guarded rejection rate."""
    n, bad = F.count(F.lit(1)), F.count_if(rejected(raw))
    return [
        n.alias("raw_records"),
        (n - bad).alias("clean_records"),
        bad.alias("rejected_records"),
        F.round(100.0 * bad / F.greatest(n, F.lit(1)), 3).alias("rejection_rate_pct"),
    ]


def run_counts(raw: DataFrame) -> DataFrame:
    """:func:`count_columns` as one row, in one pass."""
    return raw.agg(*count_columns(raw))
