"""Feature groups: a registry, append-only parquet per group, and point-in-time reads."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ledgerloom.operators.asof import asof_join
from ledgerloom.operators.chunks import ROWS_PER_CHUNK
from ledgerloom.plans.snapshots import Layout, SnapshotTable
from ledgerloom.schema import ENTITY, FEATURE_GROUPS, TIME
from ledgerloom.session import together, utc_now
from ledgerloom.sources.files import exists

REGISTRATION = """group_name string, features array<string>, entity_col string, event_time_col string,
                  description string, registered_at timestamp_ntz"""
INLINE_ENTITIES = 1_000
STAMP = "_ingested_at"


def available(names: list[str], columns: list[str]) -> list[str]:
    """The names that exist, in their given order."""
    have = set(columns)
    return [n for n in names if n in have]


def as_of_rows(df: DataFrame, as_of: datetime, time: str = TIME) -> DataFrame:
    """Rows known at ``as_of``, inclusive; rows without a time are not."""
    return df.where(F.col(time) <= F.lit(as_of).cast("timestamp_ntz"))


def only_entities(df: DataFrame, entities: list | DataFrame | None, entity: str = ENTITY) -> DataFrame:
    """Rows of the given entities; no or an empty list means all.

    A short list becomes a pushed-down IN; a long one or a DataFrame becomes a semi join.
    """
    if entities is None or (isinstance(entities, list) and not entities):
        return df
    if isinstance(entities, list):
        if len(entities) <= INLINE_ENTITIES:
            return df.where(F.col(entity).isin(entities))
        kind = df.schema[entity].dataType.simpleString()
        entities = df.sparkSession.createDataFrame([(e,) for e in entities], f"{entity} {kind}")
    return df.join(entities.select(entity), entity, "left_semi")


def project_features(df: DataFrame, names: list[str] | None, entity: str = ENTITY) -> DataFrame:
    """Entity and the existing features among ``names``; all columns without names."""
    return df.select(entity, *available(names, df.columns)) if names else df


def latest_per_entity(df: DataFrame, entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """Last row of each entity. Equal times are decided by the remaining columns.

    The rank limit leaves one row per entity and map task before the exchange.
    """
    rest = [F.col(c).desc_nulls_last() for c in df.columns if c not in (entity, time)]
    spec = Window.partitionBy(entity).orderBy(F.col(time).desc_nulls_last(), *rest)
    return (df.withColumn("_rank", F.row_number().over(spec))
            .where(F.col("_rank") == 1).drop("_rank"))


def join_latest(groups: dict[str, DataFrame], entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """Full outer combination of the groups' latest rows, one row per entity.

    Written as one union and one aggregate: each group's latest row is the maximum of
    (time, features), combined map-side, so any number of groups costs one exchange and a
    hot entity is reduced before it moves. Later groups' columns of an already used name are
    prefixed with their group.
    """
    used, parts, picks = {entity}, [], []
    for i, (name, df) in enumerate(groups.items()):
        columns = [c for c in df.columns if c not in (entity, time, STAMP)]
        body = F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"f{j}") for j, c in enumerate(columns)])
        # A group without a time for a row still has the row: (NULL, ...) sorts lowest.
        parts.append(df.select(F.col(entity), body.alias(f"_g{i}")))
        for j, c in enumerate(columns):
            out = c if c not in used else f"{name}_{c}"
            used.add(out)
            picks.append(F.col(f"_g{i}.f{j}").alias(out))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    best = united.groupBy(entity).agg(*[F.max(f"_g{i}").alias(f"_g{i}") for i in range(len(parts))])
    return best.select(entity, *picks)


class FeatureStore:
    """Feature groups below ``root``.

    A ``clustered`` store keeps each group in folders by day of its event time and in ranges of
    its entity, with Bloom filters: lookups of few entities or of a past time skip the rest. A
    store stays as it was made; what is ingested is read twice, once to sample the ranges.
    """

    def __init__(self, spark: SparkSession, root: str, clustered: bool = False):
        self.spark = spark
        self.root = root.rstrip("/")
        self.clustered = clustered

    # -- registry --------------------------------------------------------------------------

    def register(self, group_name: str, features: list[str], entity_col: str = ENTITY,
                 event_time_col: str = TIME, description: str = "") -> None:
        """Register a group or replace its registration."""
        self._append([(group_name, features, entity_col, event_time_col, description, utc_now())])

    def register_catalog(self, catalog: dict[str, list[str]]) -> None:
        """Register all groups of a catalog that are not registered like this yet."""
        known = {r.group_name: r for r in self.registry().collect()}
        new = [(name, features, ENTITY, TIME, "", utc_now()) for name, features in catalog.items()
               if name not in known or (known[name].features, known[name].entity_col,
                                        known[name].event_time_col) != (features, ENTITY, TIME)]
        if new:
            self._append(new)

    def _append(self, rows: list[tuple]) -> None:
        (self.spark.createDataFrame(rows, REGISTRATION).coalesce(1)
         .write.mode("append").json(f"{self.root}/registry"))

    def registry(self) -> DataFrame:
        """The last registration of each group."""
        if not exists(self.spark, f"{self.root}/registry"):
            return self.spark.createDataFrame([], REGISTRATION)
        rows = self.spark.read.schema(REGISTRATION).json(f"{self.root}/registry")
        newest = F.max_by(F.struct(*rows.columns), "registered_at").alias("r")
        return rows.groupBy(F.col("group_name").alias("g")).agg(newest).select("r.*")

    def _registration(self, group_name: str):
        row = self.registry().where(F.col("group_name") == group_name).first()
        if row is None:
            raise ValueError(f"feature group {group_name!r} is not registered")
        return row

    # -- data ------------------------------------------------------------------------------

    def table(self, group_name: str) -> SnapshotTable:
        """The group's rows: a snapshot table, so batches, schemas and counts are on record."""
        info = self._registration(group_name)
        return self._table(group_name, info.entity_col, info.event_time_col)

    def _table(self, group_name: str, entity: str, time: str) -> SnapshotTable:
        layout = Layout(time, (entity, time)) if self.clustered else None
        return SnapshotTable(self.spark, f"{self.root}/groups/{group_name}", layout)

    def ingest(self, group_name: str, df: DataFrame, batch_id: str | None = None,
               stamp: datetime | None = None) -> None:
        """Append rows to a group; a batch that was ingested before is not added again."""
        info = self._registration(group_name)
        self._append_rows(group_name, df, batch_id, stamp, info.entity_col, info.event_time_col)

    def _append_rows(self, group_name: str, df: DataFrame, batch_id: str | None, stamp: datetime | None, entity: str, time: str) -> None:
        at = F.lit(stamp) if stamp else F.current_timestamp()
        self._table(group_name, entity, time).write(df.withColumn(STAMP, at.cast("timestamp_ntz")), batch_id=batch_id)

    def get_features(self, group_name: str, entity_ids: list | DataFrame | None = None,
                     feature_names: list[str] | None = None, as_of: datetime | None = None) -> DataFrame:
        """A group's history up to ``as_of`` for the entities, with the named features.

        Conditions and projection reach the parquet scan.
        """
        info = self._registration(group_name)
        df = self._table(group_name, info.entity_col, info.event_time_col).read(until=as_of if self.clustered else None)
        if not df.columns:
            return df
        if as_of is not None and info.event_time_col in df.columns:
            df = as_of_rows(df, as_of, info.event_time_col)
        if info.entity_col in df.columns:
            df = only_entities(df, entity_ids, info.entity_col)
        return project_features(df, feature_names, info.entity_col)

    def join_feature_groups(self, group_names: list[str], entity_ids: list | DataFrame | None = None,
                            as_of: datetime | None = None) -> DataFrame:
        """One row per entity with each group's latest features at ``as_of``.

        Groups without data are left out; an unregistered group is an error.
        """
        frames, entity = {}, None
        for name in group_names:
            info = self._registration(name)
            df = self.get_features(name, entity_ids, None, as_of)
            if not df.columns:
                continue
            entity = entity or info.entity_col
            frames[name] = df.withColumnsRenamed({info.entity_col: entity, info.event_time_col: TIME})
        if not frames:
            return self.spark.createDataFrame([], T.StructType([]))
        return join_latest(frames, entity, TIME)

    def asof_features(self, rows: DataFrame, group_names: list[str], entity: str = ENTITY, time: str = TIME,
                      max_age: timedelta | None = None, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
        """``rows`` with each group's features as they were known at every row's own time.

        Only history of the rows' entities up to the last row's time is read. Groups without data are left out; an
        unregistered group is an error.
        """
        last = rows.agg(F.max(time)).first()[0]
        histories = {}
        for name in group_names:
            info = self._registration(name)
            df = self.get_features(name, rows.select(F.col(entity).alias(info.entity_col)).distinct(), None, last)
            if df.columns:
                histories[name] = df.drop(STAMP).withColumnsRenamed({info.entity_col: entity, info.event_time_col: TIME})
        return asof_join(rows, histories, entity, time, TIME, max_age, rows_per_chunk)

    def describe(self) -> DataFrame:
        """One row per group: number of features, and of records from its commits."""
        registered = self.registry().select("group_name", F.size("features").alias("features"))
        names = [r[0] for r in registered.select("group_name").collect()]
        counts = [self._table(n, ENTITY, TIME).history().select(F.lit(n).alias("group_name"), "num_records") for n in names]
        if not counts:
            return registered.withColumn("records", F.lit(0).cast("bigint"))
        records = reduce(DataFrame.union, counts).groupBy("group_name").agg(F.sum("num_records").alias("records"))
        return registered.join(records, "group_name", "left").fillna(0, ["records"])


def registry_totals(described: DataFrame) -> DataFrame:
    """Numbers of groups, features and records of a ``describe`` result."""
    return described.agg(
        F.count(F.lit(1)).alias("feature_groups"),
        F.coalesce(F.sum("features"), F.lit(0)).alias("total_features"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"))


def build_training_store(spark: SparkSession, df: DataFrame, root: str, batch_id: str,
                         catalog: dict[str, list[str]] = FEATURE_GROUPS,
                         stamp: datetime | None = None, clustered: bool = False) -> FeatureStore:
    """Register every catalog group and ingest those with at least one computed feature."""
    store = FeatureStore(spark, root, clustered)
    store.register_catalog(catalog)
    groups = {name: available(features, df.columns) for name, features in catalog.items()} if ENTITY in df.columns else {}
    # Each group is a table of its own: they are written side by side.
    together(spark, *[
        partial(store._append_rows, name, df.select(ENTITY, TIME, *found), batch_id, stamp, ENTITY, TIME)
        for name, found in groups.items() if found])
    return store
