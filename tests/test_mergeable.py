"""Sketch profiles, row changes between versions, digests of windows, risk over hops, payloads, streams."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.contracts import Contract
from ledgerloom.operators.network import spread_risk
from ledgerloom.operators.payloads import drifting_fields, payload_columns, payload_fields, with_payload
from ledgerloom.operators.profile import drift, estimates, merge_profiles, profile, stable_profile
from ledgerloom.plans.jobs import LedgerJob, backfill_changed, backfill_rows, window_digests
from ledgerloom.plans.snapshots import SnapshotTable
from ledgerloom.session import scratch_dir
from ledgerloom.sources.dead_letters import read_dead_letters, write_dead_letters
from ledgerloom.sources.files import names
from ledgerloom.sources.samples import tx_events
from ledgerloom.sources.windows import SourceConfig
from ledgerloom.streaming.activity import activity, panes, sessions
from ledgerloom.streaming.ingest import read_stream


# -- profiles ------------------------------------------------------------------------------

def test_merged_profiles_equal_the_direct_one_within_the_bounds(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(3, 1) for _ in range(40_000)]
    df = spark.createDataFrame([(v, f"key{i % 9000}", i % 7) for i, v in enumerate(values)], "x double, k string, part int")
    parts = profile(df, ["x", "k"], ["part"])
    merged, direct = ({r.column: r for r in estimates(p).collect()} for p in (merge_profiles(parts), profile(df, ["x", "k"])))
    values.sort()
    for found in (merged, direct):
        assert (found["x"].records, found["x"].nulls, found["x"].low, found["x"].high) == (40_000, 0, values[0], values[-1])
        for share, at in zip((0.1, 0.25, 0.5, 0.75, 0.9), found["x"].quantiles):
            assert abs(sum(v <= at for v in values) / 40_000 - share) < 0.015
        assert found["k"].distinct == pytest.approx(9000, rel=0.08) and found["k"].members == pytest.approx(9000, rel=0.08)
        assert found["k"].quantiles == [None] * 5 and (found["k"].first, found["k"].last) == ("key0", "key999")


def test_profiles_of_nothing(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, k string")
    for p in (profile(df), merge_profiles(profile(df).unionByName(profile(df.limit(0))))):
        found = {r.column: r for r in estimates(p).collect()}
        assert found["x"].quantiles == [None] * 5 and found["k"].distinct == 0 and found["x"].nulls == found["x"].records == 2
    assert {r.records for r in profile(df.limit(0)).collect()} == {0}
    assert all(not r.shifted for r in drift(profile(df), profile(df)).collect())


def test_drift(spark):
    before = spark.range(1000).select((F.col("id") * 1.0).alias("x"), F.concat(F.lit("k"), (F.col("id") % 5)).alias("k"), F.lit("a").alias("gone"))
    after = before.drop("gone").withColumns({"x": F.col("x") + 200, "k": F.when(F.col("k") != "k0", F.col("k"))})
    found = {r.column: r for r in drift(profile(before), profile(after)).collect()}
    assert found["x"].shifted and not found["x"].passed and found["gone"].one_sided and not found["gone"].passed
    assert found["k"].null_change == pytest.approx(0.2) and found["k"].overlap == pytest.approx(0.8) and not found["k"].passed
    assert all(r.passed for r in drift(profile(before), profile(before)).collect())
    report = Contract("c", [stable_profile(profile(before.select("x", "k")))]).report(after).first()
    assert not report.passed and report.details == {"x": 1.0, "k": 1.0}


def test_a_job_keeps_profiles_of_its_windows(spark, sf):
    inbox = scratch_dir(spark, "landed")
    tx_events(spark, sf).write.parquet(inbox)
    job = LedgerJob(spark, [SourceConfig("all", inbox)], scratch_dir(spark, "job"), profiles=True)
    days = [datetime(2024, 1, d) for d in (5, 7, 9)]
    for a, b in [*zip(days, days[1:]), (days[0], days[1])]:
        job.run(a, b)
    found = {r.column: r for r in job.profile(days[0], days[2]).collect()}
    raw = tx_events(spark, sf).where(F.col("timestamp").between(days[0], days[2]))
    assert found["chain"].records == raw.count() and found["amount_usd"].nulls == raw.where("amount_usd IS NULL").count()
    assert {r.records for r in job.profile(days[1], days[2]).collect()} == {raw.where(F.col("timestamp") >= days[1]).count()}


# -- changes -------------------------------------------------------------------------------

def test_changes_are_a_multiset_difference(spark):
    rng = random.Random(5)
    table = SnapshotTable(spark, scratch_dir(spark, "table"))
    versions = [[]]
    for _ in range(5):
        rows = [(rng.choice([1, 2, None]), rng.choice(["a", None])) for _ in range(20)]
        mode = rng.choice(["append", "append", "overwrite"])
        table.write(spark.createDataFrame(rows, "id long, k string"), mode)
        versions.append((versions[-1] if mode == "append" else []) + rows)
    for a in range(6):
        for b in (5, a):
            found = Counter()
            for r in table.changes(a, b).collect():
                found[r.id, r.k] += r.copies if r.change == "added" else -r.copies
            expected = Counter(versions[b])
            expected.subtract(versions[a])
            assert found == Counter({k: n for k, n in expected.items() if n})
    with pytest.raises(ValueError):
        table.changes(1, 9)


def test_changes_read_no_folder_that_both_versions_have(spark):
    table = SnapshotTable(spark, scratch_dir(spark, "table"))
    for v in range(3):
        table.write(spark.createDataFrame([(v, [v], None)], "id long, list array<long>, late string") if v else spark.createDataFrame([(v, [v])], "id long, list array<long>"))
    changed = table.changes(2, 3)
    assert len(changed.inputFiles()) == len(table.read_batch(3).inputFiles())
    assert [(r.id, r.list, r.late, r.change, r.copies) for r in changed.collect()] == [(2, [2], None, "added", 1)]
    at = table.compact()
    assert table.changes(3, at).isEmpty() and table.changes(at, at).isEmpty()


# -- digests -------------------------------------------------------------------------------

END = datetime(2024, 1, 12)


def test_digests_see_every_change_and_no_order(spark, sf):
    df = tx_events(spark, sf)
    base = window_digests(df, END, 5)
    assert window_digests(df.repartition(7), END, 5).exceptAll(base).isEmpty() and base.count() == 5
    row = df.where(F.col("timestamp").between(END - timedelta(days=2), END - timedelta(days=1))).limit(1)
    for other in (df.unionByName(row), df.exceptAll(row), df.exceptAll(row).unionByName(row.withColumn("chain", F.lit(None).cast("string"))),
                  df.exceptAll(row).unionByName(row.withColumns({"chain": F.col("tx_type"), "tx_type": F.col("chain")}))):
        assert window_digests(other, END, 5).exceptAll(base).count() == 1


@pytest.mark.parametrize("across", [False, True])
def test_only_changed_windows_are_made_again(spark, sf, across):
    df, path, day = tx_events(spark, sf), scratch_dir(spark, "backfill"), timedelta(days=1)
    assert len(backfill_changed(df, END, path, 10, "range", across)) == 10
    assert backfill_changed(df, END, path, 10, "range", across) == []
    gone = END - 4 * day
    other = df.where(~F.coalesce(F.col("timestamp").between(gone, gone + day), F.lit(False)))
    redone = backfill_changed(other, END, path, 10, "range", across)
    assert redone == ([gone + k * day for k in range(4)] if across else [gone])
    whole = backfill_rows(other, END, 10, "range", across)
    found = spark.read.parquet(path).drop("window")
    assert f"window={gone:%Y%m%dT%H%M%S}" not in names(spark, path)
    assert found.count() == whole.count() > 0
    same = [c for c in whole.columns if not c.startswith("amount_")]
    assert found.select(same).exceptAll(whole.select(same)).isEmpty()
    # The next span: one new window, and those it reaches into are read, not made.
    assert backfill_changed(other, END + day, path, 10, "range", across) == [END]


# -- risk ----------------------------------------------------------------------------------

def brute_risk(edges, labels, hops, decay):
    best = {}
    for address, risk in labels:
        if address is not None and risk is not None and (address not in best or risk > best[address][0]):
            best[address] = (risk, 0)
    level = {a: r for a, (r, _) in best.items()}
    for hop in range(1, hops + 1):
        following = {}
        for payer, paid in edges:
            if payer is not None and payer != paid and paid in level:
                following[payer] = max(following.get(payer, 0), level[paid] * decay)
        for a, r in following.items():
            if a not in best or r > best[a][0]:
                best[a] = (r, hop)
        level = following
    return best


def test_risk_spreads_as_by_brute_force(spark):
    rng = random.Random(8)
    address = lambda: rng.choice([f"a{i}" for i in range(30)] + ["hub"] * 10 + [None])
    edges = [(address(), address()) for _ in range(120)]
    labels = [("a1", 0.9), ("a1", 0.4), ("a2", 0.5), (None, 1.0), ("a3", None), ("outside", 0.7)]
    found = spread_risk(spark.createDataFrame(edges, "from_address string, to_address string"), spark.createDataFrame(labels, "address string, risk_score double"), 4, 0.5)
    assert {r.address: (r.risk, r.hops) for r in found.collect()} == brute_risk(edges, labels, 4, 0.5)


def test_risk_stops_by_itself(spark, monkeypatch):
    from ledgerloom.operators import network
    staged, keep = [], network.stage
    monkeypatch.setattr(network, "stage", lambda df, name: (staged.append(name), keep(df, name))[1])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from_address string, to_address string")
    labels = spark.createDataFrame([("c", 1.0)], "address string, risk_score double")
    assert sorted(map(tuple, spread_risk(edges, labels, 50, 0.5).collect())) == [("a", 0.25, 2), ("b", 0.5, 1), ("c", 1.0, 0)]
    assert sum(n.startswith("grown") for n in staged) == 3
    assert spread_risk(edges, labels.limit(0), 3).isEmpty() and spread_risk(edges.limit(0), labels, 3).count() == 1


# -- payloads ------------------------------------------------------------------------------

def test_fields_of_payloads(spark):
    texts = ['{"a": 1, "b": {"c": [1, 2]}}', '{"a": 2.5}', '{"a": 10000000000}', "[1]", "7", "{", None, '{"b": {"c": ["x"], "d": null}}', "{}"]
    df = with_payload(spark.createDataFrame([(t, i // 5) for i, t in enumerate(texts)], "text string, batch int"), "text")
    whole = {r.field: (r.type, r.n) for r in payload_fields(df).collect()}
    assert whole["a"][1] == 3 and whole["a"][0].startswith(("DECIMAL", "DOUBLE")) and whole["b"] == ("OBJECT<c: ARRAY<VARIANT>, d: VOID>", 2)
    by_batch = payload_fields(df, by=["batch"])
    assert {(r.batch, r.field) for r in by_batch.collect()} == {(0, "a"), (0, "b"), (1, "b")}
    drifted = {r.field: r for r in drifting_fields(by_batch, ["batch"]).collect()}
    assert drifted["a"].missing == 1 and len(drifted["b"].types) == 2
    typed = payload_columns(df, {"a": ("$.a", "double"), "c": ("$.b.c[0]", "string"), "d": ("$.a", "boolean")}).collect()
    assert [(r.a, r.c) for r in typed] == [(1.0, "1"), (2.5, None), (1e10, None), *[(None, None)] * 4, (None, "x"), (None, None)]
    assert payload_fields(df.limit(0)).collect() == []


def test_dead_letters_keep_types(spark):
    root = scratch_dir(spark, "dead")
    first = spark.createDataFrame([("h", {"k": 1}, [1.5], datetime(2024, 1, 1), timedelta(days=1))],
                                  "transaction_hash string, tags map<string,int>, list array<double>, timestamp timestamp_ntz, wait interval day to second")
    write_dead_letters(first, root, "s", "b1")
    write_dead_letters(spark.createDataFrame([("h2", "text")], "transaction_hash string, tags string"), root, "s", "b2")
    found = payload_columns(read_dead_letters(spark, root), {"tag": ("$.tags.k", "int"), "number": ("$.list[0]", "double"), "kind": ("$.tags", "string")}, "body")
    rows = {r.batch_id: r for r in found.collect()}
    assert (rows["b1"].tag, rows["b1"].number, rows["b1"].timestamp) == (1, 1.5, datetime(2024, 1, 1))
    assert (rows["b2"].tag, rows["b2"].kind) == (None, "text")


# -- streams -------------------------------------------------------------------------------

SCHEMA = "timestamp timestamp_ntz, from_address string, amount_usd double"
AT = datetime(2024, 1, 1)


def streamed(spark, batches, made, mode="append"):
    """Rows a stream puts out for deliveries in order, and the state rows it holds at the end."""
    inbox, root = scratch_dir(spark, "inbox"), scratch_dir(spark, "out")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    stream = made(read_stream(spark, inbox, spark.createDataFrame([], SCHEMA).schema, 1))
    run = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
           .trigger(availableNow=True).start(f"{root}/rows"))
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows").collect(), sum(s["numRowsTotal"] for s in run.lastProgress["stateOperators"])


def hours(*at, address="a"):
    return [(AT + timedelta(hours=h), address, 10.0) for h in at]


def test_sessions_close_in_silence_and_late_rows_are_dropped(spark):
    batches = [hours(0, 5) + [(AT, None, 1.0), (None, "a", 1.0)], hours(4, 9), hours(60), hours(61), hours(1), hours(200, address="flush")]
    found, held = streamed(spark, batches, lambda s: sessions(s, "10 hours", "24 hours"))
    assert sorted((r.from_address, r.first_time, r.last_time, r.dormant_at, r.txn_count) for r in found) == [
        ("a", AT, AT + timedelta(hours=9), AT + timedelta(hours=33), 4), ("a", AT + timedelta(hours=60), AT + timedelta(hours=61), AT + timedelta(hours=85), 2)]
    assert held == 1  # the open session only


def test_rows_within_the_delay_count(spark):
    batches = [hours(30), hours(22), hours(100, address="flush")]
    found, _ = streamed(spark, batches, lambda s: activity(s, "12 hours", span="2 hours", busy=1))
    assert sorted({r.window_start for r in found}) == [AT + timedelta(hours=h) for h in (21, 22, 29, 30)]


def test_state_is_given_up(spark):
    batches = [[(AT + timedelta(days=d, hours=h), f"a{h}", 1.0) for h in range(20)] for d in range(6)]
    _, held = streamed(spark, batches, lambda s: panes(s, "1 hour"))
    assert held <= 25  # of 120 panes
