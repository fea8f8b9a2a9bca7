"""Batch jobs: one window end to end, backfill, run records and the load check."""

from __future__ import annotations

import json
import time
import traceback
from datetime import datetime, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

from ledgerloom.operators.chain import transform_chain
from ledgerloom.operators.contracts import Contract, accepted, count_columns, summarize
from ledgerloom.operators.profile import merge_profiles, profile
from ledgerloom.operators.features import WEEK, Prior, Thresholds, add_features
from ledgerloom.plans.entity_state import EntityState
from ledgerloom.plans.feature_store import build_training_store, registry_totals
from ledgerloom.plans.seen_keys import SeenKeys
from ledgerloom.plans.snapshots import Layout, SnapshotTable
from ledgerloom.schema import ENTITY, KEY_COLUMNS, TIME
from ledgerloom.session import scratch_dir, stage, together, utc_now
from ledgerloom.sources.dead_letters import write_dead_letters
from ledgerloom.sources.files import create, exists, remove
from ledgerloom.sources.windows import STAMP, SourceConfig, advance_mark, extract_all, in_window, read_mark

RUN = """run_id string, start_time timestamp_ntz, end_time timestamp_ntz, status string,
         metrics map<string,double>, errors array<struct<at: timestamp_ntz, error: string>>"""


def batch_name(start: datetime, end: datetime) -> str:
    return f"{start.strftime(STAMP)}-{end.strftime(STAMP)}"


class LedgerJob:
    """Loads time windows of the sources into the tables below ``root``.

    Every write is keyed by the window, so a run can be repeated after any failure: finished
    steps are no-ops and unfinished ones are replaced. A window that the job chose itself is
    written down before work starts, and a later run replays it as it was, whatever the time.

    ``all_features`` fills every group of the catalog instead of those that the chain's own
    columns belong to. Frames read the table back by the longest of them, lifetime facts go on
    from the state that earlier windows left, so windows give the values that one window over
    all rows gives. Ages, preferred values and ranks within a day are as known at the window's
    end. ``labels`` are those of ``add_features``. With ``unique`` a hash that an earlier window
    has loaded is not loaded again; without, hashes are unique per window only. With
    ``profiles`` the sketches of each raw window are kept, and ``profile`` merges those of a span.
    """

    def __init__(self, spark: SparkSession, sources: list[SourceConfig], root: str,
                 name: str = "ledger", contract: Contract | None = None, frame: str = "rows",
                 all_features: bool = False, labels: DataFrame | None = None,
                 limits: Thresholds = Thresholds(), unique: bool = False, profiles: bool = False):
        self.spark = spark
        self.sources = sources
        self.root = root.rstrip("/")
        self.name = name
        self.contract = contract or Contract(name)
        self.frame = frame
        self.all_features = all_features
        self.labels = labels
        self.limits = limits
        self.table = SnapshotTable(spark, f"{self.root}/transactions", Layout(TIME))
        self.state = EntityState(spark, f"{self.root}/state")
        self.profiles = SnapshotTable(spark, f"{self.root}/profiles") if profiles else None
        self.seen = SeenKeys(spark, f"{self.root}/keys", self.table, "transaction_hash") if unique else None

    def run(self, start: datetime | None = None, end: datetime | None = None) -> dict:
        """Load ``[start, end)``; by default from the last mark, or one hour, up to now.

        Without ``start``, a window that was begun from this mark and not finished is replayed
        with the end it had then; the next run goes on from there. Returns the run record that is also appended to ``runs``. A failed run is recorded,
        leaves the mark where it was and raises.
        """
        end = end or utc_now()
        if start is None:
            start, end = self._intended(read_mark(self.spark, f"{self.root}/marks", self.name), end)
        batch = batch_name(start, end)
        record = {"run_id": f"run-{utc_now():%Y%m%dT%H%M%S%f}", "start_time": start, "end_time": end,
                  "status": "running", "metrics": {}, "errors": []}
        try:
            record["metrics"] = self._load(start, end, batch)
            record["status"] = "success"
            advance_mark(self.spark, f"{self.root}/marks", self.name, end)
        except Exception:
            record["status"] = "failed"
            record["errors"].append((utc_now(), traceback.format_exc()))
            raise
        finally:
            self._record(record)
        return record

    def _intended(self, mark: datetime | None, end: datetime) -> tuple[datetime, datetime]:
        """The window that starts at the mark, as the first run that began it wrote it down."""
        start = mark or end - timedelta(hours=1)
        path = f"{self.root}/windows/{self.name}@{mark.strftime(STAMP) if mark else 'first'}.json"
        window = {"start": start.isoformat(), "end": end.isoformat()}
        if not create(self.spark, path, json.dumps(window)):
            window = self.spark.read.schema("start string, end string").json(path).first()
        return datetime.fromisoformat(window["start"]), datetime.fromisoformat(window["end"])

    def _with_features(self, version: int, start: datetime, end: datetime, batch: str) -> DataFrame:
        """The rows that a version added, with all features.

        Earlier rows are there for the frames of their entities, and those of the window's
        first day for ranks within the day.
        """
        until = F.col(TIME) < F.lit(end).cast("timestamp_ntz")
        # Of the table only the days are opened that frames reach into.
        rows = self.table.read(version, True, start - timedelta(microseconds=WEEK), end).where(until).withColumn("_fresh", F.col("_v") == version)
        entities = self.table.read_batch(version).select(ENTITY).distinct().withColumn("_known", F.lit(True))
        facts, counts = self.state.before(batch, start, entities.select(ENTITY), self.table.read(version, until=start).where(until))
        day = F.lit(datetime(start.year, start.month, start.day)).cast("timestamp_ntz")
        context = rows.join(entities, ENTITY, "left").where(F.col("_known") | (F.col(TIME) >= day)).drop("_known", "_v")
        return add_features(context, as_of=end, labels=self.labels, limits=self.limits,
                            prior=Prior(facts, counts, "_fresh")).where("_fresh").drop("_fresh")

    def _publish(self, version: int, start: datetime, end: datetime, batch: str) -> DataFrame:
        """Ingest a version's features; returns the store's description."""
        loaded = self.table.read_batch(version)
        # Every group reads its columns of the staged rows.
        featured = stage(self._with_features(version, start, end, batch), "features") if self.all_features else loaded
        steps = [lambda: build_training_store(self.spark, featured, f"{self.root}/features", batch)]
        if self.all_features:
            steps.append(lambda: self.state.record(batch, loaded, end))
        return together(self.spark, *steps)[0].describe()

    def _load(self, start: datetime, end: datetime, batch: str) -> dict[str, float]:
        began = time.monotonic()
        # The sources are read once, into the shared folder: counts, report and rows then speak of
        # the same records, whatever arrives meanwhile, and each step reads few columns of them.
        path = scratch_dir(self.spark, "window")
        try:
            counts, verdict, (version, repeats) = self._ingest(path, start, end, batch)
        finally:
            remove(self.spark, path)
        described = self._publish(version, start, end, batch)
        totals = registry_totals(described).first()
        by_group = {f"feature_records.{r.group_name}": float(r.records) for r in described.collect()}
        return {
            "raw_records": float(counts["raw_records"]),
            "clean_records": float(counts["clean_records"]),
            "rejected_records": float(counts["rejected_records"]),
            "rejection_rate_pct": float(counts["rejection_rate_pct"]),
            "snapshot_version": float(version),
            "feature_groups": float(totals.feature_groups),
            "feature_records": float(totals.total_records),
            "validation_passed": float(verdict.passed),
            "rules_failed": float(verdict.rules_failed),
            **repeats,
            **by_group,
            "elapsed_seconds": round(time.monotonic() - began, 2),
        }

    def _ingest(self, path: str, start: datetime, end: datetime, batch: str) -> tuple[dict, Row, tuple[int, dict[str, float]]]:
        """Copy the raw window to ``path`` and load it: its counts, the contract's verdict and what ``_commit`` returns."""
        counted = Observation()
        raw = extract_all(self.sources, start, end)
        raw.observe(counted, *count_columns(raw)).write.parquet(path)
        counts, raw = counted.get, self.spark.read.schema(raw.schema).parquet(path)
        clean, bad, report = self.contract.split(raw)
        steps = [lambda: summarize(report, self.name, utc_now()).first(), lambda: self._commit(clean, start, end, batch)]
        if counts["rejected_records"]:
            steps.append(partial(write_dead_letters, bad, f"{self.root}/dead_letters", self.name, batch))
        if self.profiles is not None:
            window = [F.lit(t).cast("timestamp_ntz").alias(n) for t, n in ((start, "window_start"), (end, "window_end"))]
            steps.append(lambda: self.profiles.write(profile(raw).select(*window, "*"), batch_id=batch))
        verdict, committed = together(self.spark, *steps)[:2]
        return counts, verdict, committed

    def _commit(self, clean: DataFrame, start: datetime, end: datetime, batch: str) -> tuple[int, dict[str, float]]:
        """Transform and commit the clean rows; the version, and what was found of hashes loaded before."""
        done = self.table.batch_version(batch)
        if done is not None:
            return done, {}
        repeats = {}
        if self.seen is not None:
            clean, asked, found = self.seen.split(clean)
            repeats = {"hashes_looked_up": float(asked), "hashes_repeated": float(found)}
        return self.table.write(transform_chain(clean, self.frame), "append",
                                {"run_start": start.isoformat(), "run_end": end.isoformat()}, batch), repeats

    def _record(self, record: dict) -> None:
        row = tuple(record[k] for k in ("run_id", "start_time", "end_time", "status", "metrics", "errors"))
        (self.spark.createDataFrame([row], RUN).coalesce(1)
         .write.mode("append").json(f"{self.root}/runs"))

    def profile(self, start: datetime, end: datetime) -> DataFrame:
        """The profile of all raw rows of the windows within a span, from their sketches."""
        since, until = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
        parts = self.profiles.read().where((F.col("window_start") >= since) & (F.col("window_end") <= until))
        return merge_profiles(parts.drop("window_start", "window_end"))

    def runs(self) -> DataFrame:
        """All run records."""
        if not exists(self.spark, f"{self.root}/runs"):
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).json(f"{self.root}/runs")


def quality_gate(committed: DataFrame, expected: int | DataFrame) -> DataFrame:
    """Check committed rows against the expected number, for null keys and repeated hashes.

    One grouped aggregate; ``expected`` is a number or a one-value DataFrame.
    """
    null_keys = F.lit(0)
    for c in KEY_COLUMNS:
        null_keys = null_keys + F.count_if(F.col(c).isNull())
    wanted = F.lit(expected) if isinstance(expected, int) else expected.scalar()
    return (committed.groupBy("transaction_hash")
            .agg(F.count(F.lit(1)).alias("n"), null_keys.alias("nulls"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
                 F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_keys"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_hashes"))
            .withColumn("expected_records", wanted.cast("bigint"))
            .withColumn("passed", (F.col("records") == F.col("expected_records"))
                        & (F.col("null_keys") == 0) & (F.col("repeated_hashes") == 0)))


def day_spine(spark: SparkSession, end: datetime, days_back: int) -> DataFrame:
    """The one-day windows that end at ``end``, as (window_start, window_end), oldest first."""
    last = F.lit(end).cast("timestamp_ntz")
    day = F.make_dt_interval(F.lit(1))
    first = F.lit(end - timedelta(days=days_back)).cast("timestamp_ntz")
    starts = F.sequence(first, last - day, day)
    return spark.range(1).select(F.explode(starts).alias("window_start")) \
        .withColumn("window_end", F.col("window_start") + day)


def in_day_windows(df: DataFrame, end: datetime, days_back: int, time_col: str = TIME) -> DataFrame:
    """Rows of the last ``days_back`` windows with their ``window_start``."""
    start = end - timedelta(days=days_back)
    offset = (end - datetime(1970, 1, 1)) % timedelta(days=1)
    rows = in_window(df, start, end, time_col)
    window = F.window(time_col, "1 day", startTime=f"{offset // timedelta(microseconds=1)} microseconds")
    return rows.withColumn("window_start", window["start"])


def backfill_rows(raw: DataFrame, end: datetime, days_back: int, frame: str = "rows", across: bool = False,
                  only: list[datetime] | None = None) -> DataFrame:
    """Transformed clean rows of all windows at once; each window is processed by itself.

    With ``across`` the time frames of a row reach back into earlier windows. ``only`` limits the
    work to windows of that start: no others are read, but for those their frames reach into.
    """
    rows = in_day_windows(raw, end, days_back)
    if only is not None:
        needed = {w - timedelta(days=k) for w in only for k in range(REACH + 1 if across else 1)}
        rows = rows.where(_within_days(sorted(needed)))
    out = transform_chain(rows.where(accepted(rows)), frame, per=["window_start"], across=across)
    return out if only is None else out.where(F.col("window_start").isin([F.lit(w).cast("timestamp_ntz") for w in only]))


REACH = 7       # days that the longest time frame reaches back


def _within_days(starts: list[datetime]) -> Column:
    """Condition on the time itself, one range per run of days, so that it reaches the scan."""
    found, at = F.lit(False), 0
    while at < len(starts):
        last = at
        while last + 1 < len(starts) and starts[last + 1] == starts[last] + timedelta(days=1):
            last += 1
        since, until = (F.lit(t).cast("timestamp_ntz") for t in (starts[at], starts[last] + timedelta(days=1)))
        found, at = found | ((F.col(TIME) >= since) & (F.col(TIME) < until)), last + 1
    return found


def backfill(raw: DataFrame, end: datetime, path: str, days_back: int = 30, frame: str = "rows") -> None:
    """Write the windows to ``path``, one partition per window, in a single job.

    Only the partitions of the windows are replaced, so a backfill can be repeated. The
    rebalance gives every partition few files and splits one that is too large for a task.
    """
    _write_windows(backfill_rows(raw, end, days_back, frame), path)


def _write_windows(rows: DataFrame, path: str) -> None:
    (rows.withColumn("window", F.date_format("window_start", WINDOW_NAME))
     .hint("rebalance", "window")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("window").parquet(path))


WINDOW_NAME = "yyyyMMdd'T'HHmmss"


def window_digests(raw: DataFrame, end: datetime, days_back: int) -> DataFrame:
    """(window_start, records, mixed, total): digests of each window's rows that don't depend on their order.

    One aggregate, combined map-side. A row's digest covers all columns and which of them are null.
    """
    rows, columns = in_day_windows(raw, end, days_back), sorted(raw.columns)
    row, gaps = F.struct(*columns), F.array(*[F.col(c).isNull() for c in columns])
    digest, other = F.xxhash64(row, gaps), F.xxhash64(F.lit("other"), gaps, row)
    return rows.groupBy("window_start").agg(
        F.count(F.lit(1)).alias("records"), F.bit_xor(digest).alias("mixed"), F.sum(F.pmod(other, F.lit(1 << 40))).alias("total"))


def backfill_changed(raw: DataFrame, end: datetime, path: str, days_back: int = 30, frame: str = "rows",
                     across: bool = False) -> list[datetime]:
    """Backfill only what has changed since the last call with this ``path``; the starts of those windows.

    A window has changed if its digest is another one, or is new or gone. With ``across`` the
    windows whose frames reach into it are made again too, and those it reaches into are read.
    Results equal a full backfill. Digests are kept in ``<path>-digests`` and written last: a
    run that fails is made up for by the next one.
    """
    spark, start = raw.sparkSession, end - timedelta(days=days_back)
    known = SnapshotTable(spark, f"{path.rstrip('/')}-digests")
    now = stage(window_digests(raw, end, days_back), "digests")
    last = known.read()
    if last.columns:
        before, since = last.where(F.col("window_start") >= F.lit(start).cast("timestamp_ntz")), F.lit(end).cast("timestamp_ntz")
        both = now.alias("a").join(before.where(F.col("window_start") < since).alias("b"), "window_start", "full")
        same = F.lit(True)
        for c in ("records", "mixed", "total"):
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        moved = both.where(~same)
    else:
        moved = now
    # At most one value per window of the span.
    changed = {r.window_start for r in moved.select("window_start").collect()}
    redo = sorted({w + timedelta(days=k) for w in changed for k in range(REACH + 1 if across else 1)
                   if w + timedelta(days=k) < end})
    if redo:
        rows = stage(backfill_rows(raw, end, days_back, frame, across, redo), "backfill")
        filled = {r.window_start for r in rows.select("window_start").distinct().collect()}
        if filled:
            _write_windows(rows, path)
        for window in set(redo) - filled:
            remove(spark, f"{path.rstrip('/')}/window={window.strftime('%Y%m%dT%H%M%S')}")
        kept = now if not last.columns else now.unionByName(last.join(now.select("window_start"), "window_start", "left_anti").where(
            (F.col("window_start") < F.lit(start).cast("timestamp_ntz")) | (F.col("window_start") >= F.lit(end).cast("timestamp_ntz"))))
        known.write(kept, "overwrite")
    return redo
