from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.feature_store import (
    FeatureStore, available, build_training_store, join_latest, latest_per_entity, only_entities,
    project_features, registry_totals)
from ledgerloom.plans.snapshots import Layout, SnapshotTable
from ledgerloom.schema import FEATURE_GROUPS
from ledgerloom.session import scratch_dir
from ledgerloom.sources.files import exists


@pytest.fixture
def table(spark):
    return SnapshotTable(spark, scratch_dir(spark, "table"))


def numbers(spark, *values):
    return spark.createDataFrame([(v, v * 10.0) for v in values], "id long, value double")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_write_and_read(spark, table):
    assert table.version == 0 and table.read().isEmpty()
    assert table.write(numbers(spark, 1, 2, 3)) == 1
    assert ids(table.read()) == [1, 2, 3]


def test_time_travel_and_history(spark, table):
    table.write(numbers(spark, 1), committed_at=datetime(2024, 1, 1))
    table.write(numbers(spark, 2), committed_at=datetime(2024, 1, 2), metadata={"note": "second"})
    assert ids(table.read(1)) == [1] and ids(table.read(2)) == [1, 2] and table.read(0).isEmpty()
    assert ids(table.read_as_of(datetime(2024, 1, 1, 12))) == [1]
    assert ids(table.read_as_of(datetime(2024, 1, 2))) == [1, 2]
    assert table.read_as_of(datetime(2023, 1, 1)).isEmpty()
    rows = table.history().orderBy("version").collect()
    assert [(r.version, r.operation, r.num_records) for r in rows] == [(1, "APPEND", 1), (2, "APPEND", 1)]
    assert rows[1].metadata == {"note": "second"}
    with pytest.raises(ValueError):
        table.read(3)


def test_overwrite_keeps_older_versions_readable(spark, table):
    for mode, v in [("append", 1), ("append", 2), ("overwrite", 3), ("append", 4)]:
        table.write(numbers(spark, v), mode)
    assert [ids(table.read(v)) for v in (1, 2, 3, 4)] == [[1], [1, 2], [3], [3, 4]]
    # State is on disk only: another spelling of the path sees the same table.
    again = SnapshotTable(spark, table.root + "/")
    assert ids(again.read()) == [3, 4]
    with pytest.raises(ValueError):
        table.write(numbers(spark, 5), "upsert")


def test_repeated_batch_is_a_no_op(spark, table):
    assert table.write(numbers(spark, 1), batch_id="b1") == 1
    assert table.write(numbers(spark, 1), batch_id="b1") == 1
    assert table.write(numbers(spark, 2), batch_id="b2") == 2
    assert ids(table.read()) == [1, 2]


def test_leftovers_of_a_failed_write_are_invisible_and_replaced(spark, table):
    table.write(numbers(spark, 1))
    numbers(spark, 8, 9).write.parquet(f"{table.root}/data/_a=left")
    assert ids(table.read()) == [1]
    assert table.write(numbers(spark, 2)) == 2
    assert ids(table.read()) == [1, 2]


def test_schema_drift(spark, table):
    table.write(spark.createDataFrame([(1,)], "id long"))
    table.write(spark.createDataFrame([(2, "x")], "id long, extra string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, None), (2, "x")]
    assert table.read(1).columns == ["id"]
    with pytest.raises(ValueError, match="id is bigint"):
        table.write(spark.createDataFrame([("3",)], "id string"))
    table.write(spark.createDataFrame([("3",)], "id string"), "overwrite")
    assert table.read().collect() == [("3",)]


def test_reads_prune_to_the_live_versions(spark, table):
    for mode, v in [("append", 1), ("overwrite", 2), ("append", 3)]:
        table.write(numbers(spark, v), mode)
    rows = table.read(3).select("id")
    folders = {f.split("/data/")[1].split("/")[0] for f in rows.inputFiles()}
    assert folders == {r.folder for r in table.history().where("version >= 2").collect()}
    assert "ReadSchema: struct<id:bigint>" in rows._jdf.queryExecution().executedPlan().toString()


def test_vacuum_never_touches_live_rows(spark, table):
    for v in range(1, 6):
        table.write(numbers(spark, v))
    assert table.vacuum() == [] and table.vacuum(2) == []
    assert ids(table.read()) == [1, 2, 3, 4, 5]


def test_vacuum_after_overwrite(spark, table):
    for mode, v in [("append", 1), ("append", 2), ("overwrite", 3), ("append", 4)]:
        table.write(numbers(spark, v), mode)
    before = ids(table.read(3)), ids(table.read(4))
    assert sorted(r.version for r in table.expired(2).collect()) == [1, 2]
    assert table.vacuum(3) == []
    folders = [f"{table.root}/data/{r.folder}" for r in table.history().where("version <= 2").collect()]
    assert table.vacuum(2) == [1, 2]
    assert table.vacuum(2) == []
    assert (ids(table.read(3)), ids(table.read(4))) == before
    assert len(folders) == 2 and not any(exists(spark, f) for f in folders)
    assert table.history().count() == 4
    with pytest.raises(ValueError, match="vacuumed"):
        table.read(2)
    assert table.write(numbers(spark, 5)) == 5
    with pytest.raises(ValueError):
        table.vacuum(0)


def test_leftovers_of_a_commit_do_not_lock_the_table(spark, table):
    spark.range(1).coalesce(1).write.json(f"{table.root}/commits/_temporary")
    assert table.version == 0 and table.history().isEmpty() and table.read().isEmpty()
    assert table.write(numbers(spark, 1)) == 1 and ids(table.read()) == [1]


def test_compaction(spark, table):
    for v in range(1, 5):
        table.write(numbers(spark, v))
    assert table.compact() == 5
    assert ids(table.read()) == ids(table.read(4)) == [1, 2, 3, 4]
    assert len(table.read().inputFiles()) == 1


# -- feature store -------------------------------------------------------------------------

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)
COLUMNS = "from_address string, timestamp timestamp_ntz, {} double"


@pytest.fixture
def store(spark):
    return FeatureStore(spark, scratch_dir(spark, "store"))


def fill(spark, store):
    store.register("a", ["x"])
    store.register("b", ["y", "z"])
    store.register("empty", ["q"])
    store.ingest("a", spark.createDataFrame([("e1", T1, 1.0), ("e1", T2, 2.0), ("e2", T1, 3.0)], COLUMNS.format("x")), "b1")
    store.ingest("b", spark.createDataFrame([("e1", T3, 7.0), ("e3", T1, 8.0), ("e3", T2, 9.0)], COLUMNS.format("y")), "b1")


def test_get_features(spark, store):
    fill(spark, store)
    assert store.get_features("a").count() == 3
    assert store.get_features("a", as_of=T1).count() == 2
    assert store.get_features("a", ["e1"], as_of=T1).first().x == 1.0
    named = store.get_features("a", feature_names=["x", "nope"])
    assert named.columns == ["from_address", "x"]
    assert store.get_features("empty").isEmpty()
    assert store.get_features("a", []).count() == 3
    with pytest.raises(ValueError):
        store.get_features("unknown")
    with pytest.raises(ValueError):
        store.ingest("unknown", numbers(spark, 1))


def test_ingest_is_append_only_and_replayable(spark, store):
    fill(spark, store)
    more = spark.createDataFrame([("e9", T1, 5.0)], COLUMNS.format("x"))
    store.ingest("a", more, "b2")
    store.ingest("a", more, "b2")
    assert store.get_features("a").count() == 4
    assert "_ingested_at" in store.get_features("a").columns and "_ingested_at" not in more.columns


def test_entity_filters(spark):
    df = spark.createDataFrame([("e1",), ("e2",), (None,)], "from_address string")
    assert only_entities(df, ["e1"]).count() == 1
    assert only_entities(df, [f"e{i}" for i in range(2, 3000)]).count() == 1
    assert only_entities(df, df.where("from_address = 'e2'")).count() == 1
    assert only_entities(df, None).count() == 3


def test_join_takes_the_latest_row_of_each_group(spark, store):
    fill(spark, store)
    rows = {r.from_address: (r.x, r.y) for r in store.join_feature_groups(["a", "b", "empty"]).collect()}
    assert rows == {"e1": (2.0, 7.0), "e2": (3.0, None), "e3": (None, 9.0)}
    rows = {r.from_address: (r.x, r.y) for r in store.join_feature_groups(["a", "b"], as_of=T1).collect()}
    assert rows == {"e1": (1.0, None), "e2": (3.0, None), "e3": (None, 8.0)}
    assert store.join_feature_groups(["a", "b"], ["e3"]).count() == 1
    with pytest.raises(ValueError):
        store.join_feature_groups(["a", "unknown"])
    assert store.join_feature_groups(["empty"]).isEmpty()


def test_join_is_one_exchange_and_keeps_equal_names_apart(spark):
    a = spark.createDataFrame([("e", T1, 1.0)], COLUMNS.format("x"))
    b = spark.createDataFrame([("e", T2, 2.0)], COLUMNS.format("x"))
    out = join_latest({"a": a, "b": b, "c": a})
    assert out.columns == ["from_address", "x", "b_x", "c_x"]
    assert out.first() == ("e", 1.0, 2.0, 1.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1


def test_latest_per_entity(spark):
    df = spark.createDataFrame([("e", T1, 1.0), ("e", T2, 2.0), ("e", T2, 3.0), ("f", None, 4.0)], COLUMNS.format("x"))
    assert {(r.from_address, r.x) for r in latest_per_entity(df).collect()} == {("e", 3.0), ("f", 4.0)}


def test_other_entity_and_time_columns(spark, store):
    store.register("w", ["v"], entity_col="wallet", event_time_col="at")
    store.ingest("w", spark.createDataFrame([("a", T1, 1.0), ("a", T2, 2.0)], "wallet string, at timestamp_ntz, v double"))
    assert store.get_features("w", ["a"], ["v"], T1).collect() == [("a", 1.0)]
    assert store.join_feature_groups(["w"]).select("wallet", "v").collect() == [("a", 2.0)]


def test_describe_and_registration(spark, store):
    fill(spark, store)
    store.register("a", ["x", "x2"])  # the last registration wins
    found = {r.group_name: (r.features, r.records) for r in store.describe().collect()}
    assert found == {"a": (2, 3), "b": (2, 3), "empty": (1, 0)}
    totals = registry_totals(store.describe()).first()
    assert (totals.feature_groups, totals.total_features, totals.total_records) == (3, 5, 6)
    assert registry_totals(FeatureStore(spark, store.root + "-none").describe()).first().feature_groups == 0


def test_training_store_keeps_available_columns(spark):
    df = spark.createDataFrame([("e", T1, 1.0, 2)], "from_address string, timestamp timestamp_ntz, amount_log double, txn_count_1h int")
    store = build_training_store(spark, df, scratch_dir(spark, "training"), "b1")
    assert store.registry().count() == len(FEATURE_GROUPS) == 5
    assert sum(len(f) for f in FEATURE_GROUPS.values()) == 41
    filled = {r.group_name for r in store.describe().where("records > 0").collect()}
    assert filled == {"transaction_velocity", "amount_statistics"}
    assert available(["b", "a"], ["a", "b", "c"]) == ["b", "a"]
    assert project_features(df, None).columns == df.columns


# -- layout --------------------------------------------------------------------------------

def scanned(df):
    """Plan, rows and files that the scan of a query without exchanges has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return plan.toString(), leaf.metrics().apply("numOutputRows").value(), leaf.metrics().apply("numFiles").value()


def test_a_clustered_store_skips_days_and_row_groups(spark, monkeypatch):
    rows = spark.range(60_000).select(
        F.concat(F.lit("e"), F.xxhash64("id") % 5000).alias("from_address"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 6).cast("int"))).alias("timestamp"), F.col("id").cast("double").alias("x"))
    rows.write.parquet(path := scratch_dir(spark, "rows"))
    rows, stores = spark.read.parquet(path), {}
    # Pages of a size that suits so few rows.
    monkeypatch.setattr(Layout, "options", lambda self, whole=Layout.options: {**whole(self), "parquet.page.row.count.limit": "100"})
    for clustered in (False, True):
        store = stores[clustered] = FeatureStore(spark, scratch_dir(spark, "store"), clustered)
        store.register("g", ["x"])
        for day in range(0, 6, 3):
            store.ingest("g", rows.where(F.dayofmonth("timestamp").between(day + 1, day + 3)), f"b{day}", T1)
        store.ingest("g", rows.limit(5), "b0", T1)
    three, until = [r[0] for r in rows.select("from_address").limit(3).collect()], datetime(2024, 1, 2)
    plain, laid = (stores[c].get_features("g", three, as_of=until) for c in (False, True))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, laid.collect())) and plain.count() > 0
    assert stores[True].get_features("g").exceptAll(stores[False].get_features("g")).isEmpty()
    text, read, files = scanned(laid)
    assert "PartitionFilters: [isnotnull(_day" in text.replace("\n", "")
    _, all_read, all_files = scanned(plain)
    every = scanned(stores[True].get_features("g"))
    # Two days of six, and of those the ranges that hold the entities.
    assert read < 0.05 * 60_000 < all_read and files < every[2] and every[1] == 60_000
    file = pq.ParquetFile(stores[True].get_features("g").inputFiles()[0].removeprefix("file://"))
    assert file.metadata.row_group(0).column(0).path_in_schema == "from_address"


def test_a_layout_survives_nulls_versions_and_compaction(spark):
    table = SnapshotTable(spark, scratch_dir(spark, "table"), Layout("t", ("k",)))
    rows = spark.createDataFrame([("a", T1), ("b", None), (None, T3)], "k string, t timestamp_ntz")
    table.write(rows)
    table.write(spark.createDataFrame([("c", T2, 1)], "k string, t timestamp_ntz, extra int"))
    found = lambda **span: sorted((r.k or "") for r in table.read(**span).collect())
    assert found() == ["", "a", "b", "c"] and found(since=T2) == ["", "c"] and found(until=T2) == ["a", "c"] and found(version=1, since=T2) == [""]
    assert table.read_batch(1).columns == ["k", "t"] and table.read().columns == ["k", "t", "extra"]
    assert [(r.k, r.change) for r in table.changes(1, 2).collect()] == [("c", "added")]
    with pytest.raises(ValueError, match="layout"):
        SnapshotTable(spark, table.root).read(since=T1)
    assert table.compact() == 3 and found(since=T2) == ["", "c"] and table.changes(2, 3).isEmpty()
