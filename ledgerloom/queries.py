"""Named queries over the sample tables, one per operator or family of operators."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.scalars import add_amount_columns, add_time_parts, invalid_member, iso_text, only_confirmed
from ledgerloom.operators import contracts as rules
from ledgerloom.operators.chain import transform_chain
from ledgerloom.operators.chunks import ROWS_PER_CHUNK, ChunkPlan, plan_chunks
from ledgerloom.operators.contracts import Contract, accepted, rejected, run_counts, summarize
from ledgerloom.operators.dedup import deduplicate, total_order
from ledgerloom.operators.drift import evolve, normalize
from ledgerloom.operators.features import Thresholds, add_features, plan_days
from ledgerloom.operators.network import spread_risk
from ledgerloom.operators.payloads import drifting_fields, payload_columns, payload_fields, with_payload
from ledgerloom.operators.profile import drift, estimates, merge_profiles, profile
from ledgerloom.operators.rolling import rolling_rows
from ledgerloom.operators.sliding import rolling_range
from ledgerloom.plans.feature_store import (
    FeatureStore, as_of_rows, available, build_training_store, latest_per_entity, only_entities,
    project_features, registry_totals)
from ledgerloom.plans.jobs import LedgerJob, backfill, backfill_changed, backfill_rows, day_spine, quality_gate
from ledgerloom.plans.snapshots import SnapshotTable
from ledgerloom.schema import CHAINS, ENTITY, FEATURE_GROUPS, STATUSES, TIME, TRANSACTION
from ledgerloom.session import adopt, scratch_dir, stage
from ledgerloom.sources.dead_letters import read_dead_letters, write_dead_letters
from ledgerloom.sources.samples import address_labels, tx_events, tx_lineitem
from ledgerloom.sources.windows import (
    SourceConfig, advance_mark, default_sources, extract_all, extract_incremental, extract_window, read_mark)
from ledgerloom.streaming.activity import activity, sessions
from ledgerloom.streaming.ingest import deduplicate_stream, ingest_stream, read_reports, read_stream

AS_OF = datetime(2024, 1, 15)
NOW = datetime(2024, 1, 20)
STAMP = datetime(2024, 2, 1)
BACKFILL_END = datetime(2024, 1, 31)
ENTITIES = ["0x1", "0x2", "0x3"]
LIMITS = Thresholds(high_value=100.0, rapid_seconds=3600, dormant_days=2, round_amount=10.0, round_step=5.0)
SMALL_CHUNK = 20  # makes the sample data take the plans for oversized groups

TX = [f.name for f in TRANSACTION.fields]
KEY = ["transaction_hash", "block_number", "timestamp"]
ROLLED = [f"{p}_{w}" for w in ("1h", "1d", "7d") for p in ("txn_count", "amount_sum", "amount_mean")]
RANGED = [f"{p}_{w}" for w in ("1h", "24h", "7d") for p in ("txn_count", "amount_sum", "amount_mean")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(adopt(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def digits(c: str | Column) -> Column:
    """Four digits; the nudge keeps halves away from the rounding edge."""
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column + 1e-9, 4)


def shown(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with doubles rounded and integers widened, for comparison."""
    kinds = dict(df.dtypes)
    return df.select(*[
        digits(c).alias(c) if kinds[c] == "double"
        else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "smallint", "tinyint")
        else F.col(c) for c in columns])


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tx_events(spark, sf_dir)
    return df.where(accepted(df))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, deduplicated, confirmed rows: what the rolling operators work on."""
    return only_confirmed(deduplicate(clean(spark, sf_dir), ["transaction_hash"]))


def address_plan(spark: SparkSession, sf_dir: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> ChunkPlan:
    """Address sizes, measured on the raw rows: cheaper, and an upper bound for the rest."""
    df = tx_events(spark, sf_dir)
    return plan_chunks(df, ENTITY, total_order(df), rows_per_chunk)


# -- sources -------------------------------------------------------------------------------

@query
def src_window(spark, sf_dir):
    source = SourceConfig("three_chains", chains=["ethereum", "bitcoin", "solana"])
    return shown(extract_window(source, datetime(2024, 1, 5), datetime(2024, 1, 12), tx_events(spark, sf_dir)), TX)


@query
def src_incremental(spark, sf_dir):
    marks = scratch_dir(spark, "marks")
    for day in (10, 12):
        advance_mark(spark, marks, "everything", datetime(2024, 1, day))
    mark = read_mark(spark, marks, "everything")
    source, df = SourceConfig("everything"), tx_events(spark, sf_dir)
    since = extract_incremental(source, datetime(2024, 1, 20), mark, records=df)
    fresh = extract_incremental(source, datetime(2024, 1, 5), None, window_minutes=90, records=df)
    return shown(since.unionByName(fresh), TX)


@query
def src_union(spark, sf_dir):
    return shown(extract_all(default_sources("unused"), datetime(2024, 1, 1), datetime(2024, 1, 20),
                             tx_events(spark, sf_dir)), TX)


@query
def src_normalize(spark, sf_dir):
    drifted = tx_events(spark, sf_dir).withColumns({
        "amount_usd": F.col("amount_usd").cast("string"),
        "block_number": F.col("block_number").cast("string"),
        "extra": F.lit(1),
    })
    return shown(normalize(drifted), TX)


# -- schema drift --------------------------------------------------------------------------

@query
def schema_evolve(spark, sf_dir):
    drifted = tx_events(spark, sf_dir).drop("gas_fee_usd").withColumns({
        "amount_usd": F.col("amount_usd").cast("string"),
        "extra": F.concat("chain", F.lit("-"), "token_symbol"),
    })
    out = evolve(drifted, {"amount_usd": "float64", "gas_fee_usd": "float64", "tx_type": "int64",
                           "block_number": "string", "timestamp": "datetime64[ns]"})
    return shown(out, ["transaction_hash", "block_number", "timestamp", "amount_usd", "gas_fee_usd", "tx_type", "extra"])


@query
def schema_defaults(spark, sf_dir):
    out = evolve(tx_events(spark, sf_dir).select("block_number"), {
        "block_number": "int64", "rate": "float64", "hops": "int64", "memo": "string", "raw": "object",
        "flag": "bool", "other": "no_such_type"})
    return shown(out, ["block_number", "rate", "hops", "memo", "raw", "flag", "other"])


def _payloads(spark, sf_dir) -> DataFrame:
    """The events' payloads, whose fields change from week to week: a number, then text, then an object; some are broken."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    number, kind = F.col("k").cast("string"), F.dayofmonth(F.to_date("day"))
    text = (F.when(F.col("event_id") % 50 == 3, F.concat(F.lit('{"k": '), number))
            .when(kind <= 10, F.concat(F.lit('{"k": '), number, F.lit("}")))
            .when(kind <= 20, F.concat(F.lit('{"k": "n'), number, F.lit('", "tag": true}')))
            .otherwise(F.concat(F.lit('{"k": {"v": '), number, F.lit('}, "tag": false}'))))
    return with_payload(df.withColumn("props", text), "props")


@query
def schema_variant(spark, sf_dir):
    """Fields and types of each day's payloads, inferred in one aggregate."""
    return shown(payload_fields(_payloads(spark, sf_dir), by=["day"]), ["day", "field", "type", "n"])


@query
def schema_variant_drift(spark, sf_dir):
    out = drifting_fields(payload_fields(_payloads(spark, sf_dir), by=["day"]), ["day"])
    return out.select("field", F.array_join("types", " | ").alias("types"), "batches", "missing")


@query
def payload_typed(spark, sf_dir):
    out = payload_columns(_payloads(spark, sf_dir), {"number": ("$.k", "bigint"), "nested": ("$.k.v", "bigint"), "said": ("$.k", "string"), "tag": ("$.tag", "boolean")})
    return out.select("event_id", F.col("payload").isNull().alias("broken"), "number", "nested", F.when(F.col("nested").isNull(), F.col("said")).alias("said"), "tag")


# -- filters -------------------------------------------------------------------------------

@query
def filter_confirmed(spark, sf_dir):
    return shown(only_confirmed(tx_events(spark, sf_dir)), TX)


@query
def reject_rows(spark, sf_dir):
    df = tx_events(spark, sf_dir)
    return shown(df.where(rejected(df)), TX)


@query
def clean_rows(spark, sf_dir):
    return shown(clean(spark, sf_dir), TX)


@query
def enum_violations(spark, sf_dir):
    df = tx_events(spark, sf_dir)
    bad_status, bad_chain = (invalid_member(F.col("status"), STATUSES), invalid_member(F.col("chain"), CHAINS))
    return df.where(bad_status | bad_chain).select(
        *KEY, "status", "chain", bad_status.alias("bad_status"), bad_chain.alias("bad_chain"))


@query
def asof_filter(spark, sf_dir):
    return shown(as_of_rows(tx_events(spark, sf_dir), AS_OF), TX)


@query
def entity_filter(spark, sf_dir):
    return shown(only_entities(tx_events(spark, sf_dir), ENTITIES), TX)


@query
def entity_semi_join(spark, sf_dir):
    df = tx_events(spark, sf_dir)
    unsure = df.where(F.col("status") == "unknown").select(ENTITY).distinct()
    return shown(only_entities(df, unsure), TX)


@query
def feature_projection(spark, sf_dir):
    df = add_amount_columns(clean(spark, sf_dir))
    out = project_features(df, ["amount_log", "no_such_feature", "total_cost_usd"])
    return shown(out, [ENTITY, "amount_log", "total_cost_usd"])


# -- deduplication -------------------------------------------------------------------------

@query
def dedup_last(spark, sf_dir):
    return shown(deduplicate(tx_events(spark, sf_dir), ["transaction_hash"], "last"), TX)


@query
def dedup_first(spark, sf_dir):
    return shown(deduplicate(tx_events(spark, sf_dir), ["transaction_hash"], "first"), TX)


@query
def dedup_none(spark, sf_dir):
    return shown(deduplicate(tx_events(spark, sf_dir), ["transaction_hash"], False), TX)


@query
def dedup_last_lineitem(spark, sf_dir):
    df = tx_lineitem(spark, sf_dir)
    return shown(deduplicate(df, ["transaction_hash"], "last"), TX)


@query
def dedup_none_lineitem(spark, sf_dir):
    return shown(deduplicate(tx_lineitem(spark, sf_dir), ["transaction_hash"], False), TX)


# -- scalar columns ------------------------------------------------------------------------

@query
def time_features(spark, sf_dir):
    return shown(add_time_parts(tx_events(spark, sf_dir)),
                 [*KEY, "year", "month", "day", "hour", "date_partition", "hour_partition"])


@query
def time_iso(spark, sf_dir):
    return tx_events(spark, sf_dir).select("block_number", iso_text(TIME).alias("iso"), iso_text(F.date_trunc("hour", TIME).cast("timestamp_ntz")).alias("hour"))


@query
def time_features_text(spark, sf_dir):
    """Calendar parts of times that came as text."""
    df = tx_events(spark, sf_dir).where(F.col(TIME).isNotNull()).withColumn(TIME, F.col(TIME).cast("string"))
    return shown(add_time_parts(df), ["block_number", "year", "month", "day", "hour", "date_partition", "hour_partition"])


@query
def amount_features(spark, sf_dir):
    return shown(add_amount_columns(clean(spark, sf_dir)), [*KEY, "amount_log", "fee_ratio", "total_cost_usd"])


# -- rolling -------------------------------------------------------------------------------

@query
def rolling_rows_frame(spark, sf_dir):
    return shown(rolling_rows(settled(spark, sf_dir), plan=address_plan(spark, sf_dir)), [*KEY, ENTITY, *ROLLED])


@query
def rolling_rows_chunked(spark, sf_dir):
    plan = address_plan(spark, sf_dir, SMALL_CHUNK)
    return shown(rolling_rows(stage(settled(spark, sf_dir), "rolling"), plan=plan), [*KEY, ENTITY, *ROLLED])


@query
def rolling_labels(spark, sf_dir):
    names = [f"{p}_{w}" for w in ("3h", "12h", "2d") for p in ("txn_count", "amount_sum", "amount_mean")]
    out = rolling_rows(settled(spark, sf_dir), windows=[3, 12, 48], plan=address_plan(spark, sf_dir))
    return shown(out, [*KEY, ENTITY, *names])


@query
def rolling_range_frame(spark, sf_dir):
    return shown(rolling_range(settled(spark, sf_dir), plan=address_plan(spark, sf_dir)), [*KEY, ENTITY, *RANGED])


@query
def rolling_range_dense(spark, sf_dir):
    out = rolling_range(settled(spark, sf_dir), plan=address_plan(spark, sf_dir), dense=0)
    return shown(out, [*KEY, ENTITY, *RANGED])


@query
def rolling_range_mixed(spark, sf_dir):
    """Small groups by RANGE windows, larger ones by running aggregates."""
    out = rolling_range(settled(spark, sf_dir), plan=address_plan(spark, sf_dir), dense=36)
    return shown(out, [*KEY, ENTITY, *RANGED])


@query
def rolling_range_chunked(spark, sf_dir):
    plan = address_plan(spark, sf_dir, SMALL_CHUNK)
    return shown(rolling_range(stage(settled(spark, sf_dir), "rolling"), plan=plan), [*KEY, ENTITY, *RANGED])


CHAINED = [*TX, "year", "month", "day", "hour", "date_partition", "hour_partition",
           "amount_log", "fee_ratio", "total_cost_usd", *ROLLED]


@query
def transform_chain_rows(spark, sf_dir):
    return shown(transform_chain(clean(spark, sf_dir)), CHAINED)


@query
def transform_chain_range(spark, sf_dir):
    return shown(transform_chain(clean(spark, sf_dir), frame="range"), [*KEY, ENTITY, "amount_log", *RANGED])


@query
def transform_chain_lineitem(spark, sf_dir):
    df = tx_lineitem(spark, sf_dir)
    return shown(transform_chain(df.where(accepted(df))), CHAINED)


@query
def transform_chain_rows_chunked(spark, sf_dir):
    return shown(transform_chain(clean(spark, sf_dir), rows_per_chunk=SMALL_CHUNK), CHAINED)


@query
def transform_chain_range_chunked(spark, sf_dir):
    out = transform_chain(clean(spark, sf_dir), frame="range", rows_per_chunk=SMALL_CHUNK)
    return shown(out, [*KEY, ENTITY, "amount_log", *RANGED])


# -- contracts -----------------------------------------------------------------------------

def _rule(df: DataFrame, rule, metrics: dict[str, str]) -> DataFrame:
    report = Contract("ledger", [rule]).report(df)
    return report.select("rule", "passed", *[
        (F.col("details")[m] if m == "pct" else F.col("details")[m].cast("bigint")).alias(name)
        for m, name in metrics.items()])


@query
def rule_nulls(spark, sf_dir):
    return _rule(tx_events(spark, sf_dir), rules.key_nulls(),
                 {"transaction_hash": "null_hashes", "timestamp": "null_times", "chain": "null_chains"})


@query
def rule_amount(spark, sf_dir):
    return _rule(tx_events(spark, sf_dir), rules.amount_positive(),
                 {"invalid_count": "invalid_count", "pct": "pct"})


@query
def rule_time(spark, sf_dir):
    return _rule(tx_events(spark, sf_dir), rules.time_range(NOW), {"future": "future", "too_old": "too_old"})


@query
def rule_time_lineitem(spark, sf_dir):
    return _rule(tx_lineitem(spark, sf_dir), rules.time_range(NOW), {"future": "future", "too_old": "too_old"})


@query
def rule_status(spark, sf_dir):
    rule = rules.allowed_values("status_valid_enum", "status", STATUSES, "status_values")
    return _rule(tx_events(spark, sf_dir), rule, {"invalid_count": "invalid_count"})


@query
def rule_unique(spark, sf_dir):
    return _rule(tx_events(spark, sf_dir), rules.hash_unique, {"duplicate_count": "duplicate_count"})


@query
def rule_unique_lineitem(spark, sf_dir):
    return _rule(tx_lineitem(spark, sf_dir), rules.hash_unique, {"duplicate_count": "duplicate_count"})


@query
def rule_chain(spark, sf_dir):
    rule = rules.allowed_values("chain_valid_enum", "chain", CHAINS, "chain_values")
    return _rule(tx_events(spark, sf_dir), rule, {"invalid_count": "invalid_count"})


@query
def contract_report(spark, sf_dir):
    report = Contract("ledger", rules.default_rules(NOW)).report(tx_events(spark, sf_dir))
    counted = F.map_filter("details", lambda k, _: k != "pct")
    findings = F.aggregate(F.map_values(counted), F.lit(0.0), lambda a, v: a + v)
    return report.select(F.col("position").cast("bigint").alias("position"), "rule", "passed",
                         findings.cast("bigint").alias("findings"))


@query
def contract_custom_rule(spark, sf_dir):
    def fee_below_amount(df: DataFrame) -> DataFrame:
        over = F.count_if(F.col("gas_fee_usd") > F.col("amount_usd"))
        return df.agg(over.alias("n")).select(
            F.lit("fee_below_amount").alias("rule"), (F.col("n") == 0).alias("passed"),
            F.create_map(F.lit("invalid_count"), F.col("n").cast("double")).alias("details"), F.lit("").alias("note"))
    contract = Contract("ledger", rules.default_rules(NOW)).add_rule(fee_below_amount)
    return summarize(contract.report(tx_events(spark, sf_dir)), "ledger").select(
        "source", "rules_passed", "rules_failed", "passed",
        F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def contract_failures(spark, sf_dir):
    report = Contract("ledger", rules.default_rules(NOW)).report(tx_events(spark, sf_dir))
    found = summarize(report, "ledger", STAMP)
    return found.select("evaluated_at", "total_records", F.explode("failures").alias("f")).select(
        "evaluated_at", "total_records", "f.rule", F.aggregate(
            F.map_values(F.map_filter("f.details", lambda k, _: k != "pct")), F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("findings"))


PROFILED = ["amount_usd", "gas_fee_usd", "block_number", "chain", "token_symbol", "status", "from_address", "to_address"]
EXACT = 32_768      # sketches that hold all values of the samples up to that many rows


@query
def contract_profile(spark, sf_dir):
    """Sketches of each day, kept and merged over a span of days."""
    df = tx_events(spark, sf_dir).withColumn("day", F.date_format(TIME, "yyyy-MM-dd"))
    parts = stage(profile(df, PROFILED, ["day"], EXACT), "profiles")
    out = estimates(merge_profiles(parts.where(F.col("day").between("2024-01-05", "2024-01-20"))), [0.1, 0.5, 0.9])
    few = F.when(F.col("low").isNull(), F.col("members")).alias("members")  # of numbers there are more than the sketch holds
    return shown(out.select("column", "records", "nulls", "low", "high", "first", "last", few,
                            *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q10", "q50", "q90"))]),
                 ["column", "records", "nulls", "low", "high", "first", "last", "members", "q10", "q50", "q90"])


@query
def contract_drift(spark, sf_dir):
    """The second half of the month against the first, with larger amounts, missing tokens and other chains."""
    df, cut = tx_events(spark, sf_dir), F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    later = df.where(F.col(TIME) >= cut).withColumns({
        "amount_usd": F.col("amount_usd") * 1.5, "token_symbol": F.when(F.col("token_symbol") != "BTC", F.col("token_symbol")),
        "chain": F.when(F.col("chain").isin("solana", "polygon"), F.col("chain")).otherwise(F.concat(F.lit("l2-"), "chain"))})
    out = drift(profile(df.where(F.col(TIME) < cut), PROFILED, None, EXACT), profile(later.drop("to_address"), [c for c in PROFILED if c != "to_address"], None, EXACT))
    return shown(out.withColumn("new_members", F.when(~F.col("column").isin("amount_usd", "gas_fee_usd", "block_number"), F.col("new_members"))),
                 ["column", "one_sided", "shifted", "null_change", "new_members", "overlap", "passed"])


def _text(spark, sf_dir) -> DataFrame:
    """The transactions with amounts and times as text, some of which says neither."""
    unreadable = F.col("tx_type") == "burn"
    return tx_events(spark, sf_dir).withColumns({
        "amount_usd": F.when(unreadable, F.lit("n/a")).otherwise(F.col("amount_usd").cast("string")),
        "timestamp": F.when(F.col("token_symbol") == "MATIC", F.lit("soon")).otherwise(F.col(TIME).cast("string"))})


@query
def contract_text_columns(spark, sf_dir):
    good, bad, _ = Contract("ledger").split(normalize(_text(spark, sf_dir)))
    return shown(good.select(*KEY, "amount_usd", F.lit("clean").alias("outcome")).unionByName(bad.select(
        *KEY[:2], F.col(TIME).try_cast("timestamp_ntz").alias(TIME), F.col("amount_usd").try_cast("double").alias("amount_usd"),
        F.lit("rejected").alias("outcome"))), [*KEY, "amount_usd", "outcome"])


@query
def rule_text_columns(spark, sf_dir):
    report = Contract("ledger", [rules.amount_positive(), rules.time_range(NOW)]).report(_text(spark, sf_dir))
    findings = F.aggregate(F.map_values(F.map_filter("details", lambda k, _: k != "pct")), F.lit(0.0), lambda a, v: a + v)
    return report.select("rule", "passed", findings.cast("bigint").alias("findings"), "total_records")


@query
def dead_letters_drift(spark, sf_dir):
    """Batches that disagree on the type of a column are still read together."""
    df, text, root = tx_events(spark, sf_dir), _text(spark, sf_dir), scratch_dir(spark, "dead_letters")
    write_dead_letters(df.where(rejected(df)), root, "ledger", "20240101")
    write_dead_letters(text.where(rejected(text)), root, "ledger", "20240102")
    out = read_dead_letters(spark, root)
    return shown(out.withColumn("said", F.col("payload")["amount_usd"]).withColumn(
        "said", F.when(F.col("amount_usd").isNull(), F.col("said"))), [*KEY, "amount_usd", "said", "batch_id"])


@query
def run_metrics(spark, sf_dir):
    return run_counts(tx_events(spark, sf_dir))


@query
def dead_letter_readback(spark, sf_dir):
    df, root = tx_events(spark, sf_dir), scratch_dir(spark, "dead_letters")
    bad = df.where(rejected(df))
    early = F.col("block_number") < 500
    for batch, rows in [("b1", bad.where(early)), ("b2", bad.where(~early)), ("b2", bad.where(~early))]:
        write_dead_letters(rows, root, "ledger", batch)
    return shown(read_dead_letters(spark, root), [*KEY, "amount_usd", "source", "batch_id"])


# -- snapshots -----------------------------------------------------------------------------

def _slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three consecutive spans of time that cover all clean rows."""
    df, at = clean(spark, sf_dir), F.col(TIME)
    a, b = F.lit(datetime(2024, 1, 11)).cast("timestamp_ntz"), F.lit(datetime(2024, 1, 21)).cast("timestamp_ntz")
    return [df.where(at < a), df.where((at >= a) & (at < b)), df.where(at >= b)]


def _versions(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    """Append, append, overwrite, append; one commit per day."""
    table = SnapshotTable(spark, scratch_dir(spark, "snapshots"))
    first, second, third = _slices(spark, sf_dir)
    for day, (rows, mode) in enumerate([(first, "append"), (second, "append"), (third, "overwrite"), (first, "append")], 1):
        table.write(rows, mode, {"day": str(day)}, f"batch-{day}", datetime(2024, 3, day))
    table.write(first, "append", batch_id="batch-4")  # repeated: adds nothing
    return table


@query
def snapshot_read(spark, sf_dir):
    table = _versions(spark, sf_dir)
    parts = [table.read(v).select(F.lit(v).cast("bigint").alias("version"), *TX) for v in (1, 2, 3, 4)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return shown(out, ["version", *TX])


@query
def snapshot_as_of(spark, sf_dir):
    return shown(_versions(spark, sf_dir).read_as_of(datetime(2024, 3, 2, 12)), TX)


@query
def snapshot_history(spark, sf_dir):
    return _versions(spark, sf_dir).history().select(
        "version", "committed_at", "operation", "num_records", "batch_id", F.col("metadata")["day"].alias("day"))


@query
def snapshot_current(spark, sf_dir):
    return _versions(spark, sf_dir).current()


@query
def snapshot_expired(spark, sf_dir):
    return _versions(spark, sf_dir).expired(retain_versions=2)


@query
def snapshot_vacuumed(spark, sf_dir):
    table = _versions(spark, sf_dir)
    table.vacuum(retain_versions=2)
    return shown(table.read(keep_version=True), ["_v", *TX])


@query
def snapshot_drift(spark, sf_dir):
    table = SnapshotTable(spark, scratch_dir(spark, "drift"))
    first, second, third = _slices(spark, sf_dir)
    table.write(first.select(*KEY, "amount_usd"))
    table.write(second.select(*KEY, "amount_usd", "gas_fee_usd"))
    table.write(third.select(*KEY, "token_symbol"))
    return shown(table.read(), [*KEY, "amount_usd", "gas_fee_usd", "token_symbol"])


# -- features ------------------------------------------------------------------------------

def _family(spark, sf_dir, group: str, rows_per_chunk: int = ROWS_PER_CHUNK, **options) -> DataFrame:
    out = add_features(settled(spark, sf_dir), [group], plan=address_plan(spark, sf_dir, rows_per_chunk),
                       day_plan=plan_days(clean(spark, sf_dir), rows_per_chunk=rows_per_chunk)
                       if group == "amount_statistics" else None, **options)
    return shown(out, [*KEY, ENTITY, *FEATURE_GROUPS[group]])


@query
def feature_velocity(spark, sf_dir):
    return _family(spark, sf_dir, "transaction_velocity")


@query
def feature_velocity_dense(spark, sf_dir):
    return _family(spark, sf_dir, "transaction_velocity", dense=0)


@query
def feature_velocity_chunked(spark, sf_dir):
    return _family(spark, sf_dir, "transaction_velocity", SMALL_CHUNK)


@query
def feature_amounts(spark, sf_dir):
    return _family(spark, sf_dir, "amount_statistics")


@query
def feature_amounts_chunked(spark, sf_dir):
    return _family(spark, sf_dir, "amount_statistics", SMALL_CHUNK)


@query
def feature_behavioral(spark, sf_dir):
    return _family(spark, sf_dir, "behavioral", as_of=AS_OF)


@query
def feature_behavioral_chunked(spark, sf_dir):
    return _family(spark, sf_dir, "behavioral", SMALL_CHUNK, as_of=AS_OF)


@query
def feature_risk(spark, sf_dir):
    return _family(spark, sf_dir, "risk_signals", limits=LIMITS)


@query
def feature_risk_dense(spark, sf_dir):
    return _family(spark, sf_dir, "risk_signals", limits=LIMITS, dense=0)


@query
def feature_risk_chunked(spark, sf_dir):
    return _family(spark, sf_dir, "risk_signals", SMALL_CHUNK, limits=LIMITS)


@query
def feature_network(spark, sf_dir):
    return _family(spark, sf_dir, "network", labels=address_labels(spark, sf_dir))


@query
def feature_network_dense(spark, sf_dir):
    return _family(spark, sf_dir, "network", labels=address_labels(spark, sf_dir), dense=0)


@query
def feature_network_chunked(spark, sf_dir):
    return _family(spark, sf_dir, "network", SMALL_CHUNK, labels=address_labels(spark, sf_dir))


def _hot(df: DataFrame) -> DataFrame:
    """Most rows under one address."""
    return df.withColumn(ENTITY, F.when(F.col("tx_type").isin("transfer", "swap", "stake"), F.lit("0xhot")).otherwise(F.col(ENTITY)))


@query
def rolling_range_hot(spark, sf_dir):
    """One address with most rows, cut into chunks of a few rows: hundreds of cut points."""
    rows = stage(_hot(settled(spark, sf_dir)), "hot")
    plan = plan_chunks(rows, ENTITY, total_order(rows), SMALL_CHUNK)
    return shown(rolling_range(rows, plan=plan), [*KEY, ENTITY, *RANGED])


SCALES = {"dust": (1e-9, 0.0), "near": (1e-3, 1e5), "large": (1e12, 0.0)}


def _scaled(spark, sf_dir, rows_per_chunk: int = ROWS_PER_CHUNK, dense: int | None = None) -> DataFrame:
    """Scale-free statistics of amounts that are tiny, nearly equal, or very large."""
    options = {} if dense is None else {"dense": dense}
    rows, plan, parts = stage(settled(spark, sf_dir), "settled"), address_plan(spark, sf_dir, rows_per_chunk), []
    for name, (factor, base) in SCALES.items():
        df = rows.withColumn("amount_usd", F.col("amount_usd") * F.lit(factor) + F.lit(base))
        out = add_features(df, ["amount_statistics"], plan=plan, **options)
        shift = 1e6 if name == "near" else 1.0
        parts.append(out.select(F.lit(name).alias("scale"), *KEY, ENTITY, (F.col("amount_cv_7d") * shift).alias("cv"),
                                F.col("amount_zscore").alias("zscore")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Near-equal doubles carry few digits of their differences.
    return out.select("scale", *KEY, ENTITY, F.round(F.col("cv") + 1e-9, 2).alias("cv"), F.round(F.col("zscore") + 1e-9, 2).alias("zscore"))


@query
def amount_scales(spark, sf_dir):
    return _scaled(spark, sf_dir)


@query
def amount_scales_dense(spark, sf_dir):
    return _scaled(spark, sf_dir, dense=0)


@query
def amount_scales_chunked(spark, sf_dir):
    return _scaled(spark, sf_dir, SMALL_CHUNK)


def _store(spark, sf_dir) -> FeatureStore:
    rows = stage(transform_chain(clean(spark, sf_dir)), "rows")  # ingested group by group
    store = build_training_store(spark, rows, scratch_dir(spark, "features"), "batch-1", stamp=STAMP)
    velocity = available(FEATURE_GROUPS["transaction_velocity"], rows.columns)
    store.ingest("transaction_velocity", rows.select(ENTITY, TIME, *velocity), "batch-1")  # repeated: no-op
    return store


VELOCITY = ["txn_count_1h", "txn_count_7d", "amount_sum_1h", "amount_sum_7d", "amount_mean_1h", "amount_mean_7d"]
AMOUNTS = ["amount_log", "fee_ratio", "total_cost_usd"]


@query
def feature_history(spark, sf_dir):
    return shown(_store(spark, sf_dir).get_features("transaction_velocity", as_of=AS_OF),
                 [ENTITY, TIME, *VELOCITY, "_ingested_at"])


@query
def feature_named(spark, sf_dir):
    out = _store(spark, sf_dir).get_features("amount_statistics", ENTITIES, ["fee_ratio", "amount_zscore"], AS_OF)
    return shown(out, [ENTITY, "fee_ratio"])


@query
def feature_latest(spark, sf_dir):
    rows = _store(spark, sf_dir).get_features("transaction_velocity", as_of=AS_OF)
    return shown(latest_per_entity(rows.drop("_ingested_at")), [ENTITY, TIME, *VELOCITY])


@query
def feature_join(spark, sf_dir):
    out = _store(spark, sf_dir).join_feature_groups(
        ["transaction_velocity", "amount_statistics", "behavioral"], as_of=AS_OF)
    return shown(out, [ENTITY, *VELOCITY, *AMOUNTS])


def _asked(df: DataFrame) -> DataFrame:
    """Rows that didn't go through, as events that ask for features."""
    return df.where(F.col("status") != "confirmed").select(ENTITY, F.col(TIME).alias("asked_at"), "block_number", F.col("amount_usd").alias("amount_log"))


ASKED = [ENTITY, "asked_at", "block_number", "amount_log", *VELOCITY, "amount_statistics_amount_log", "fee_ratio", "total_cost_usd"]


@query
def feature_asof_join(spark, sf_dir):
    """Features of two groups as known at each event's own time, at most three days old; one name is taken."""
    out = _store(spark, sf_dir).asof_features(_asked(tx_events(spark, sf_dir)), ["transaction_velocity", "amount_statistics", "behavioral"],
                                              time="asked_at", max_age=timedelta(days=3))
    return shown(out, ASKED)


@query
def feature_asof_join_hot(spark, sf_dir):
    """Most rows of both sides under one address, which is cut into chunks."""
    rows = stage(transform_chain(_hot(clean(spark, sf_dir))), "rows")
    store = build_training_store(spark, rows, scratch_dir(spark, "features"), "batch-1", stamp=STAMP)
    out = store.asof_features(_asked(_hot(tx_events(spark, sf_dir))), ["transaction_velocity", "amount_statistics"],
                              time="asked_at", rows_per_chunk=SMALL_CHUNK)
    return shown(out, ASKED)


@query
def feature_clustered(spark, sf_dir):
    """Three entities at a past time, from a store clustered by day and entity."""
    rows = stage(transform_chain(clean(spark, sf_dir)), "rows")
    store = build_training_store(spark, rows, scratch_dir(spark, "features"), "batch-1", stamp=STAMP, clustered=True)
    return shown(store.get_features("transaction_velocity", ENTITIES, as_of=AS_OF), [ENTITY, TIME, *VELOCITY, "_ingested_at"])


@query
def feature_describe(spark, sf_dir):
    out = _store(spark, sf_dir).describe()
    return out.select("group_name", F.col("features").cast("bigint").alias("features"), "records")


@query
def feature_totals(spark, sf_dir):
    return registry_totals(_store(spark, sf_dir).describe())


# -- jobs ----------------------------------------------------------------------------------

@query
def backfill_days(spark, sf_dir):
    spine = day_spine(spark, BACKFILL_END, 30)
    rows = tx_events(spark, sf_dir).where(F.col(TIME).isNotNull()).select(
        F.date_trunc("day", TIME).cast("timestamp_ntz").alias("window_start"))
    counts = rows.groupBy("window_start").agg(F.count(F.lit(1)).alias("raw_records"))
    return spine.join(counts, "window_start", "left").fillna(0, ["raw_records"])


@query
def backfill_transform(spark, sf_dir):
    path = scratch_dir(spark, "backfill")
    backfill(tx_events(spark, sf_dir), BACKFILL_END, path)
    backfill(tx_events(spark, sf_dir), BACKFILL_END, path, days_back=2)  # repeats the last two windows
    return shown(spark.read.parquet(path), ["window_start", *KEY, ENTITY, *ROLLED])


@query
def backfill_shifted(spark, sf_dir):
    """Windows that do not start at midnight."""
    out = backfill_rows(tx_events(spark, sf_dir), BACKFILL_END - timedelta(hours=7), 20)
    return shown(out, ["window_start", *KEY, ENTITY, "txn_count_7d", "amount_sum_7d"])


@query
def backfill_after_changes(spark, sf_dir):
    """Backfilled, then again after one row has changed and one day has lost all its rows: only their windows, and those that look back on them."""
    path, df = scratch_dir(spark, "backfill"), tx_events(spark, sf_dir)
    backfill_changed(df, BACKFILL_END, path, 30, "range", across=True)
    other = df.withColumn("amount_usd", F.when(F.col("block_number") == 500, F.col("amount_usd") + 7.0).otherwise(F.col("amount_usd")))
    other = other.where(F.coalesce(F.date_format(TIME, "yyyy-MM-dd") != "2024-01-20", F.lit(True)))
    redone = backfill_changed(other, BACKFILL_END, path, 30, "range", across=True)
    backfill_changed(other, BACKFILL_END, path, 30, "range", across=True)  # nothing has changed
    again = F.col("window_start").isin([F.lit(w).cast("timestamp_ntz") for w in redone]).alias("redone")
    return shown(spark.read.parquet(path).select("*", again), ["window_start", "redone", *KEY, ENTITY, *RANGED])


@query
def load_check(spark, sf_dir):
    rows = clean(spark, sf_dir)
    table = SnapshotTable(spark, scratch_dir(spark, "gate"))
    version = table.write(only_confirmed(deduplicate(rows, ["transaction_hash"])))
    committed = table.history().where(F.col("version") == version).select("num_records")
    return quality_gate(table.read(version), committed)


@query
def load_check_failing(spark, sf_dir):
    """Rows with repeated and missing keys, checked against a number that is not theirs."""
    df = tx_events(spark, sf_dir)
    return quality_gate(df, clean(spark, sf_dir).agg(F.count(F.lit(1))))


class _Interrupted(LedgerJob):
    """A job that fails after its commit."""

    def _publish(self, *_):
        raise RuntimeError("interrupted")


def _jobs(spark, sf_dir) -> LedgerJob:
    """Three days; three more that fail after the commit; a retry that asks for a later end."""
    root, inbox = scratch_dir(spark, "job"), scratch_dir(spark, "landed")
    tx_events(spark, sf_dir).write.parquet(inbox)
    sources = [SourceConfig("all", inbox)]
    job = LedgerJob(spark, sources, root, all_features=True, labels=address_labels(spark, sf_dir), limits=LIMITS)
    job.run(datetime(2024, 1, 5), datetime(2024, 1, 8))
    try:
        _Interrupted(spark, sources, root).run(end=datetime(2024, 1, 11))
    except RuntimeError:
        pass
    job.run(end=datetime(2024, 1, 12))
    return job


@query
def job_run(spark, sf_dir):
    return shown(_jobs(spark, sf_dir).table.read(), CHAINED)


@query
def job_runs(spark, sf_dir):
    metric = F.col("metrics")
    return _jobs(spark, sf_dir).runs().select(
        "start_time", "end_time", "status", *[metric[m].cast("bigint").alias(m) for m in (
            "raw_records", "clean_records", "rejected_records", "snapshot_version", "feature_groups", "feature_records")],
        F.size("errors").cast("bigint").alias("errors"))


@query
def job_features(spark, sf_dir):
    """Every group of the catalog holds every loaded row, once."""
    store = FeatureStore(spark, f"{_jobs(spark, sf_dir).root}/features")
    out = store.describe()
    return out.select("group_name", F.col("features").cast("bigint").alias("features"), "records")


def _apart(df: DataFrame) -> DataFrame:
    """The rows from 15 January on: a third of the addresses is silent for 45 more days, a third for 10."""
    user = F.substring(ENTITY, 3, 20).cast("bigint") % 3
    days = F.when(F.col(TIME) < F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz"), 0).when(user == 0, 45).when(user == 1, 10).otherwise(0)
    return df.withColumn(TIME, F.col(TIME) + F.make_dt_interval(days))


APART = [datetime(2024, 1, 1), datetime(2024, 1, 10, 12), datetime(2024, 2, 5), datetime(2024, 4, 1)]


@query
def job_feature_values(spark, sf_dir):
    """All features of three windows, one of which begins within a day; gaps of 10 and 45 days lie between rows."""
    root, inbox = scratch_dir(spark, "job"), scratch_dir(spark, "landed")
    _apart(tx_events(spark, sf_dir)).write.parquet(inbox)
    job = LedgerJob(spark, [SourceConfig("all", inbox)], root, all_features=True, labels=address_labels(spark, sf_dir), limits=LIMITS)
    for start, end in zip(APART, APART[1:]):
        job.run(start, end)
    store = FeatureStore(spark, f"{root}/features")
    out = None
    for group in FEATURE_GROUPS:
        part = store.get_features(group).drop("_ingested_at")
        out = part if out is None else out.join(part, [ENTITY, TIME])
    return shown(out, [ENTITY, TIME, *[f for g in FEATURE_GROUPS.values() for f in g]])


REPLAYED = [datetime(2024, 1, 5), datetime(2024, 1, 9), datetime(2024, 1, 13), datetime(2024, 1, 17)]


@query
def job_unique(spark, sf_dir):
    """Three windows; every third row comes again four days later, often in the next window."""
    root, inbox = scratch_dir(spark, "job"), scratch_dir(spark, "landed")
    df = tx_events(spark, sf_dir)
    again = df.where("block_number % 3 = 0").withColumns({TIME: F.col(TIME) + F.make_dt_interval(F.lit(4)), "block_number": F.col("block_number") + 1_000_000})
    df.unionByName(again).write.parquet(inbox)
    job = LedgerJob(spark, [SourceConfig("all", inbox)], root, unique=True)
    for start, end in zip(REPLAYED, REPLAYED[1:]):
        job.run(start, end)
    return shown(job.table.read(), [*KEY, ENTITY, "status", *ROLLED])


@query
def snapshot_compacted(spark, sf_dir):
    table = _versions(spark, sf_dir)
    table.compact()
    return shown(table.read(keep_version=True), ["_v", *TX])


@query
def snapshot_changes(spark, sf_dir):
    """Row changes over an append, over an overwrite with repeated rows, and over a compaction, which has none."""
    table = SnapshotTable(spark, scratch_dir(spark, "snapshots"))
    first, second, third = _slices(spark, sf_dir)
    for rows, mode in [(first, "append"), (second, "append"), (third.unionByName(second).unionByName(second), "overwrite"), (first, "append")]:
        table.write(rows, mode)
    table.compact()
    spans = [(1, 2), (2, 3), (1, 4), (4, 5)]
    parts = [table.changes(a, b).select(F.lit(f"{a}-{b}").alias("span"), *TX, "change", "copies") for a, b in spans]
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), ["span", *TX, "change", "copies"])


@query
def network_risk_hops(spark, sf_dir):
    """Risk of labelled addresses, spread to those that pay them over three hops; one address pays and is paid by many."""
    address = lambda c: F.concat(F.lit("0x"), (F.substring(c, 3, 20).cast("bigint") % 40).cast("string"))
    rows = clean(spark, sf_dir)
    rows = rows.select(F.when(F.col("tx_type") == "mint", F.lit("0xhub")).otherwise(address(ENTITY)).alias(ENTITY),
                       F.when(F.col("tx_type") == "stake", F.lit("0xhub")).when(F.col("tx_type") == "swap", F.concat(F.lit("0xfar"), "to_address"))
                       .otherwise(address("to_address")).alias("to_address"))
    labels = address_labels(spark, sf_dir).where("category IN ('risky', 'mixer')").withColumn("risk_score", F.col("risk_score") + 0.1)
    labels = labels.where(F.substring("address", 3, 20).cast("bigint") % 4 == 1)
    return shown(spread_risk(rows, labels, 3, 0.5), ["address", "risk", "hops"])


@query
def stream_ingest(spark, sf_dir):
    root, inbox = scratch_dir(spark, "stream"), scratch_dir(spark, "inbox")
    tx_events(spark, sf_dir).hint("rebalance").write.parquet(inbox)
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(read_stream(spark, inbox, files_per_batch=2), root, "loader", f"{root}/checkpoint").awaitTermination()
    loaded = SnapshotTable(spark, f"{root}/transactions").read().select(F.lit("clean").alias("outcome"), *TX)
    dropped = read_dead_letters(spark, f"{root}/dead_letters").select(F.lit("rejected").alias("outcome"), *TX)
    return shown(loaded.unionByName(dropped), ["outcome", *TX])


@query
def stream_report(spark, sf_dir):
    """Findings of the row rules, added up over the micro-batches."""
    root, inbox = scratch_dir(spark, "stream"), scratch_dir(spark, "inbox")
    tx_events(spark, sf_dir).repartition(4).write.parquet(inbox)
    contract = Contract("ledger", rules.default_rules(NOW))
    ingest_stream(read_stream(spark, inbox, files_per_batch=1), root, "loader", f"{root}/checkpoint", contract=contract).awaitTermination()
    row_rules = read_reports(spark, root).where(F.col("total_records").isNotNull())
    findings = F.aggregate(F.map_values(F.map_filter("details", lambda k, _: k != "pct")), F.lit(0.0), lambda a, v: a + v)
    return row_rules.groupBy("rule").agg(F.sum(findings).cast("bigint").alias("findings"), F.sum("total_records").alias("total_records"))


@query
def stream_dedup(spark, sf_dir):
    root, inbox = scratch_dir(spark, "stream"), scratch_dir(spark, "inbox")
    clean(spark, sf_dir).write.parquet(inbox)
    unique = deduplicate_stream(read_stream(spark, inbox), ["transaction_hash"], "2 days")
    (unique.select("transaction_hash").writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
     .start(f"{root}/unique").awaitTermination())
    return spark.read.parquet(f"{root}/unique").select("transaction_hash")


ROWS_PER_FILE = 250_000


def _deliveries(spark: SparkSession, parts: list[DataFrame], rows: int) -> DataFrame:
    """A stream that has each part in one micro-batch; ``rows`` is the size of the largest.

    Every delivery is as many files as a micro-batch takes. Empty files make up for a part that
    filled fewer, so that no batch begins the next delivery.
    """
    inbox, files = scratch_dir(spark, "inbox"), 1 + rows // ROWS_PER_FILE
    written = 0
    for part in parts:
        part.repartition(files).write.mode("append").parquet(inbox)
        written += files
        missing = written - len(spark.read.schema(part.schema).parquet(inbox).inputFiles())
        for _ in range(missing if part is not parts[-1] else 0):
            spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(inbox)
    return read_stream(spark, inbox, files_per_batch=files)


@query
def stream_dedup_rows(spark, sf_dir):
    """Whole rows: each comes again an hour later with another amount, and a new one comes a month late."""
    rows = stage(deduplicate(clean(spark, sf_dir), ["transaction_hash"], "first"), "unique")
    again = rows.withColumns({TIME: F.col(TIME) + F.make_dt_interval(F.lit(0), F.lit(1)), "amount_usd": F.col("amount_usd") + 1.0})
    late = rows.where("block_number = 1").withColumns({"transaction_hash": F.lit("0xlate"), TIME: F.lit(datetime(2023, 12, 1)).cast("timestamp_ntz")})
    stream = _deliveries(spark, [rows, again, late], rows.count())
    out = _closed(deduplicate_stream(stream, ["transaction_hash"], "3 days"))
    return shown(out.withColumn(TIME, F.col(TIME).cast("timestamp_ntz")), TX)


FLUSH = datetime(2025, 1, 1)


def _delivered(spark, sf_dir) -> DataFrame:
    """A stream of three deliveries: the rows in two of them, then one that is weeks late and one that lets every window close."""
    rows = clean(spark, sf_dir)
    half = F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    late = rows.where("block_number = 100").limit(1)
    last = late.withColumn(TIME, F.lit(datetime(2024, 1, 3)).cast("timestamp_ntz")).unionByName(
        late.withColumns({TIME: F.lit(FLUSH).cast("timestamp_ntz"), ENTITY: F.lit("0xflush")}))
    return _deliveries(spark, [rows.where(F.col(TIME) < half), rows.where(F.col(TIME) >= half), last], rows.count())


def _closed(stream: DataFrame) -> DataFrame:
    """What the stream has put out when it has read all there is."""
    spark = stream.sparkSession
    root = scratch_dir(spark, "closed")
    (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start(f"{root}/rows").awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


@query
def stream_activity(spark, sf_dir):
    """Each address over 24 hours, hour by hour, from panes of one hour."""
    out = _closed(activity(_delivered(spark, sf_dir), "2 days", busy=5, high_value=100.0))
    return shown(out, ["window_start", "window_end", ENTITY, "txn_count", "amount_sum", "max_single_txn", "busy_flag", "high_value_flag"])


@query
def stream_sessions(spark, sf_dir):
    """Sessions that ended with two days of silence."""
    out = _closed(sessions(_delivered(spark, sf_dir), "2 days", "2 days"))
    return shown(out, [ENTITY, "first_time", "last_time", "dormant_at", "txn_count", "amount_sum"])
