from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.jobs import LedgerJob, backfill, backfill_rows, day_spine, quality_gate
from ledgerloom.plans.snapshots import SnapshotTable
from ledgerloom.session import scratch_dir, together
from ledgerloom.sources.dead_letters import read_dead_letters
from ledgerloom.sources.files import names
from ledgerloom.sources.samples import tx_events
from ledgerloom.sources.windows import (
    SourceConfig, advance_mark, default_sources, extract_all, extract_incremental, extract_window, in_window, read_mark)
from ledgerloom.streaming.ingest import deduplicate_stream, ingest_stream, read_stream

START, END = datetime(2024, 1, 5), datetime(2024, 1, 8)


@pytest.fixture(scope="module")
def landed(spark, sf):
    """The sample records as one parquet folder."""
    path = scratch_dir(spark, "landed")
    tx_events(spark, sf).write.parquet(path)
    return path


def test_windows_are_half_open(small):
    at = datetime(2024, 3, 10, 9, 5)
    assert in_window(small, datetime(2024, 3, 10), at).count() + in_window(small, at, datetime(2024, 3, 11)).count() == 5
    assert in_window(small, at, at + timedelta(hours=1)).count() == 1


def test_extract_is_repeatable_and_tagged(landed):
    source = SourceConfig("one", landed, ["ethereum"])
    first, second = (extract_window(source, START, END) for _ in range(2))
    assert first.count() == second.count() > 0
    assert {(r.chain, r._source) for r in first.select("chain", "_source").distinct().collect()} == {("ethereum", "one")}
    text = explained(first)
    assert "GreaterThanOrEqual(timestamp,2024-01-05" in text and "EqualTo(chain,ethereum)" in text


def explained(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_sources_laid_out_by_day_are_pruned(spark, landed):
    path = scratch_dir(spark, "days")
    df = spark.read.parquet(landed).where("timestamp is not null").withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    df.repartition("day").write.partitionBy("day").parquet(path)
    part = extract_window(SourceConfig("one", path, day_column="day"), START, END)
    assert "PartitionFilters: [isnotnull(day" in explained(part)
    assert part.count() == extract_window(SourceConfig("one", landed), START, END).count()
    assert "day" not in extract_all([SourceConfig("one", path, day_column="day")], START, END).columns


def test_several_sources(spark, landed):
    both = extract_all([SourceConfig("a", landed, ["ethereum"]), SourceConfig("b", landed, ["bitcoin"])], START, END)
    assert {r._source for r in both.select("_source").distinct().collect()} == {"a", "b"}
    assert both.columns[0] == "transaction_hash" and "from_address" in both.columns
    assert [s.name for s in default_sources("x")] == ["ethereum_mainnet", "bitcoin_mainnet", "polygon_matic", "solana_mainnet"]


def test_marks(spark):
    path = scratch_dir(spark, "marks")
    assert read_mark(spark, path, "s") is None
    advance_mark(spark, path, "s", START)
    advance_mark(spark, path, "s", END)
    advance_mark(spark, path, "s", START)
    advance_mark(spark, path, "other/one", datetime(2030, 1, 1))
    assert read_mark(spark, path, "s") == END
    assert len(names(spark, path)) == 2  # earlier marks are gone


def test_incremental(landed):
    source = SourceConfig("one", landed)
    since = extract_incremental(source, END, START)
    assert since.count() == extract_window(source, START, END).count()
    assert extract_incremental(source, END, None, 60).where(F.col("timestamp") < END - timedelta(hours=1)).isEmpty()


def test_run_end_to_end_and_replay(spark, landed):
    job = LedgerJob(spark, [SourceConfig("all", landed)], scratch_dir(spark, "job"))
    run = job.run(START, END)
    m = run["metrics"]
    assert run["status"] == "success"
    assert m["raw_records"] == m["clean_records"] + m["rejected_records"]
    assert m["rejected_records"] == read_dead_letters(spark, f"{job.root}/dead_letters").count() > 0
    loaded = job.table.read()
    assert "amount_mean_7d" in loaded.columns and m["snapshot_version"] == 1
    assert m["feature_records"] == 2 * loaded.count()
    commit = job.table.history().first()
    assert commit.metadata["run_start"] == START.isoformat()

    again = job.run(START, END)
    assert again["metrics"]["snapshot_version"] == 1 and job.table.version == 1
    assert again["metrics"]["feature_records"] == m["feature_records"]
    nxt = job.run(end=END + timedelta(days=1))
    assert nxt["start_time"] == END and job.table.version == 2
    assert [r.status for r in job.runs().collect()] == ["success"] * 3


def test_retry_after_the_commit_adds_no_row(spark, landed, monkeypatch):
    from ledgerloom.plans import jobs
    job = LedgerJob(spark, [SourceConfig("all", landed)], scratch_dir(spark, "job"))
    job.run(START, START + timedelta(days=1))

    def broken(*_):
        raise RuntimeError("after the commit")
    with monkeypatch.context() as patched:
        patched.setattr(jobs, "build_training_store", broken)
        with pytest.raises(RuntimeError):
            job.run(end=END)
    assert job.table.version == 2
    again = job.run(end=END + timedelta(hours=5))
    assert (again["start_time"], again["end_time"]) == (START + timedelta(days=1), END)
    rows = job.table.read()
    assert job.table.version == 2 and rows.count() == rows.select("transaction_hash").distinct().count()
    assert job.run(end=END + timedelta(hours=5))["start_time"] == END
    failed = job.runs().where("status = 'failed'").first()
    assert "after the commit" in failed.errors[0].error and "Traceback" in failed.errors[0].error


def test_job_fills_all_groups(spark, landed, sf):
    from ledgerloom.plans.feature_store import FeatureStore
    from ledgerloom.sources.samples import address_labels
    job = LedgerJob(spark, [SourceConfig("all", landed)], scratch_dir(spark, "job"), all_features=True,
                    labels=address_labels(spark, sf))
    job.run(START, START + timedelta(days=2))
    job.run(end=END)
    rows = job.table.read().count()
    described = FeatureStore(spark, f"{job.root}/features").describe().collect()
    assert len(described) == 5 and {r.records for r in described} == {rows}


def test_failed_run_is_recorded_and_keeps_the_mark(spark):
    job = LedgerJob(spark, [SourceConfig("none", "/tmp/no-such-folder-of-records")], scratch_dir(spark, "job"))
    with pytest.raises(Exception):
        job.run(START, END)
    row = job.runs().first()
    assert row.status == "failed" and len(row.errors) == 1
    assert read_mark(spark, f"{job.root}/marks", "ledger") is None and job.table.version == 0


def test_quality_gate(small, spark):
    rows = small.withColumn("chain", F.lit("ethereum"))
    assert not quality_gate(rows, 5).first().passed  # a repeated hash
    unique = rows.dropDuplicates(["transaction_hash"])
    assert quality_gate(unique, 4).first().passed
    assert not quality_gate(unique, 3).first().passed
    assert quality_gate(unique, spark.range(4).agg(F.count("*"))).first().passed


def test_day_spine(spark):
    rows = day_spine(spark, datetime(2024, 1, 4, 6), 3).collect()
    assert [r.window_start for r in rows] == [datetime(2024, 1, d, 6) for d in (1, 2, 3)]
    assert rows[-1].window_end == datetime(2024, 1, 4, 6)


def test_backfill_equals_single_windows_and_can_be_repeated(spark, sf):
    from ledgerloom.operators.chain import transform_chain
    from ledgerloom.operators.contracts import accepted
    df, path = tx_events(spark, sf), scratch_dir(spark, "backfill")
    backfill(df, END, path, 3)
    backfill(df, END, path, 1)
    written = spark.read.parquet(path)
    assert written.select("window").distinct().count() == 3
    for day in range(3):
        start = START + timedelta(days=day)
        rows = in_window(df, start, start + timedelta(days=1))
        alone = transform_chain(rows.where(accepted(rows)))
        part = written.where(F.col("window_start") == start)
        assert alone.exceptAll(part.select(*alone.columns)).isEmpty() and alone.count() == part.count()
    assert backfill_rows(df, END, 3).count() == written.count()


def test_stream_ingest_equals_batch_and_resumes(spark, sf):
    root, inbox = scratch_dir(spark, "stream"), scratch_dir(spark, "inbox")
    df = tx_events(spark, sf)
    df.where("block_number < 600").repartition(3).write.parquet(inbox)

    def load():
        query = ingest_stream(read_stream(spark, inbox, files_per_batch=1), root, "loader", f"{root}/checkpoint")
        query.awaitTermination()
        return SnapshotTable(spark, f"{root}/transactions").read().count() + \
            read_dead_letters(spark, f"{root}/dead_letters").count()

    assert load() == 600
    assert SnapshotTable(spark, f"{root}/transactions").version == 3
    df.where("block_number >= 600").coalesce(1).write.mode("append").parquet(inbox)
    assert load() == 1000
    assert read_dead_letters(spark, f"{root}/dead_letters").count() == 38


def test_stream_dedup_keeps_one_row_per_hash(spark, sf):
    inbox, out = scratch_dir(spark, "inbox"), scratch_dir(spark, "unique")
    df = tx_events(spark, sf)
    df.write.parquet(inbox)
    rows = deduplicate_stream(read_stream(spark, inbox), ["transaction_hash"], "40 days")
    (rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
     .trigger(availableNow=True).start(out).awaitTermination())
    found = spark.read.parquet(out)
    expected = df.where("transaction_hash is not null and timestamp is not null").select("transaction_hash").distinct()
    assert found.count() == expected.count() == found.select("transaction_hash").distinct().count()


def test_independent_steps_all_end_before_a_failure_is_raised(spark):
    ended = []

    def fail():
        raise ValueError("one step")

    assert together(spark, lambda: 1, lambda: spark.range(3).count()) == [1, 3]
    assert together(spark) == []
    with pytest.raises(ValueError, match="one step"):
        together(spark, fail, lambda: ended.append(spark.range(5).count()))
    assert ended == [5]
