"""Versioned snapshots of a parquet dataset, readable at a version or a point in time.

Every attempt to write puts its rows into a folder of its own, ``data/_a=<attempt>``, and then
appends one row to ``commits`` that names the folder and the version. Readers open only folders
that commits name, so what a failed writer has left is never seen. An overwrite replaces all
earlier rows: the rows of version v are the folders from the latest overwrite up to v.

A table has one writer at a time; keeping writers apart is left to whatever schedules them.

With a ``Layout`` an attempt's rows lie in folders by day, which reads of a span of time skip, and
in ranges of the cluster columns, sorted, with parquet Bloom filters on the first of them: a
lookup of few entities reads the row groups that may hold them. A table keeps its layout.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F, types as T

from ledgerloom.session import utc_now
from ledgerloom.sources.files import exists, names, remove

COMMIT = """version bigint, committed_at timestamp_ntz, operation string, num_records bigint,
            schema string, metadata map<string,string>, batch_id string, folder string"""


DAY = "_day"


@dataclass(frozen=True)
class Layout:
    """``day`` is the time column that day folders are made of, ``cluster`` the columns rows are sorted by.

    Ranges of the cluster columns are sampled, so the rows should be cheap to read twice.
    ``entities`` is the number of distinct values the Bloom filter of a row group is made for.
    """

    day: str
    cluster: tuple[str, ...] = ()
    entities: int = 100_000

    def dealt(self, df: DataFrame) -> DataFrame:
        out = df.withColumn(DAY, F.date_format(self.day, "yyyy-MM-dd"))
        if not self.cluster:
            return out.hint("rebalance", DAY)
        return out.repartitionByRange(DAY, *self.cluster).sortWithinPartitions(DAY, *self.cluster)

    def options(self) -> dict[str, str]:
        if not self.cluster:
            return {}
        return {f"parquet.bloom.filter.enabled#{self.cluster[0]}": "true",
                f"parquet.bloom.filter.expected.ndv#{self.cluster[0]}": str(self.entities)}


class SnapshotTable:
    """A dataset at ``root``; all state is on disk and read afresh."""

    def __init__(self, spark: SparkSession, root: str, layout: Layout | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.layout = layout

    # -- commits ---------------------------------------------------------------------------

    def history(self) -> DataFrame:
        """All commits. Order by ``version`` to list them; data of vacuumed versions is gone."""
        if not exists(self.spark, f"{self.root}/commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.root}/commits")

    def current(self) -> DataFrame:
        """The current version as one row, 0 for an empty table."""
        return self.history().agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))

    def _commits(self) -> list[Row]:
        """Number, kind, batch and folder of all commits, in order: one narrow pass over a few bytes a commit."""
        if not exists(self.spark, f"{self.root}/commits"):
            return []
        return sorted(self.history().select("version", "operation", "batch_id", "folder").collect(), key=lambda r: r.version)

    @property
    def version(self) -> int:
        return max((r.version for r in self._commits()), default=0)

    def version_as_of(self, ts: datetime) -> int:
        """Last version committed at or before ``ts``, 0 if there is none."""
        at = F.lit(ts).cast("timestamp_ntz")
        return self.history().where(F.col("committed_at") <= at).agg(
            F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def batch_version(self, batch_id: str) -> int | None:
        """The version that committed a batch."""
        return next((r.version for r in self._commits() if r.batch_id == batch_id), None)

    @staticmethod
    def _live(commits: list[Row], version: int) -> list[Row]:
        """The commits whose rows make up a version."""
        upto = [r for r in commits if r.version <= version]
        floor = max((r.version for r in upto if r.operation == "OVERWRITE"), default=1)
        return [r for r in upto if r.version >= floor]

    def live_commits(self) -> int:
        """How many commits the rows of the current version lie in."""
        commits = self._commits()
        return len(self._live(commits, commits[-1].version)) if commits else 0

    # -- write -----------------------------------------------------------------------------

    def write(self, df: DataFrame, mode: str = "append", metadata: dict[str, str] | None = None,
              batch_id: str | None = None, committed_at: datetime | None = None) -> int:
        """Write the next version and return it; a batch that is already committed is a no-op."""
        if mode not in ("append", "overwrite"):
            raise ValueError(f"mode must be 'append' or 'overwrite', not {mode!r}")
        commits = self._commits()
        done = next((r.version for r in commits if batch_id is not None and r.batch_id == batch_id), None)
        if done is not None:
            return done
        last = commits[-1].version if commits else 0
        if mode == "append" and last:
            self._check_types(df, self._live(commits, last))
        folder, counted = f"_a={uuid.uuid4().hex}", Observation()
        rows = df.observe(counted, F.count(F.lit(1)).alias("n"))
        if self.layout is None:
            rows.write.mode("error").parquet(f"{self.root}/data/{folder}")
        else:
            (self.layout.dealt(rows).write.mode("error").options(**self.layout.options())
             .partitionBy(DAY).parquet(f"{self.root}/data/{folder}"))
        commit = (last + 1, committed_at or utc_now(), mode.upper(), counted.get["n"], df.schema.json(),
                  {k: str(v) for k, v in (metadata or {}).items()}, batch_id, folder)
        self.spark.createDataFrame([commit], COMMIT).coalesce(1).write.mode("append").json(f"{self.root}/commits")
        return last + 1

    def _check_types(self, df: DataFrame, live: list[Row]) -> None:
        kinds = [(f.name, f.dataType.simpleString()) for f in self._fields(live[-1:])]
        if kinds == [(f.name, f.dataType.simpleString()) for f in df.schema]:
            return
        known = {f.name: f.dataType for f in self._fields(live)}
        for f in df.schema:
            if f.name in known and known[f.name].simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {known[f.name].simpleString()} in the table and "
                                 f"{f.dataType.simpleString()} in the batch; cast it before writing")

    def compact(self) -> int:
        """Rewrite the live rows as one version of few files."""
        at = self.version
        if not at:
            return 0
        rows = self.read(at)
        return self.write(rows if self.layout else rows.hint("rebalance"), "overwrite", {"compacted": str(at)})

    # -- read ------------------------------------------------------------------------------

    def _fields(self, live: list[Row]) -> list[T.StructField]:
        """Columns of the commits, oldest first, from what they wrote down rather than from file footers."""
        found = self.history().where(F.col("version").between(live[0].version, live[-1].version)).select("version", "schema").collect()
        fields: dict[str, T.StructField] = {}
        for schema in dict.fromkeys(r.schema for r in sorted(found, key=lambda r: r.version)):
            for f in T.StructType.fromJson(json.loads(schema)).fields:
                fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        return list(fields.values())

    def _rows(self, fields: list[T.StructField], folders: list[str], since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Rows of some folders, with ``_a``; of a span of time, with a layout, only its days are opened."""
        inside = [T.StructField("_a", T.StringType()), *([T.StructField(DAY, T.StringType())] if self.layout else [])]
        rows = self.spark.read.schema(T.StructType([*fields, *inside])).option("basePath", f"{self.root}/data").parquet(
            *[f"{self.root}/data/{f}" for f in folders])
        if self.layout is None:
            return rows
        at = F.col(self.layout.day)
        for edge, compare in ((since, "__ge__"), (until, "__le__")):
            if edge is not None:
                rows = rows.where(getattr(F.col(DAY), compare)(f"{edge:%Y-%m-%d}") & getattr(at, compare)(F.lit(edge).cast("timestamp_ntz")))
        return rows.drop(DAY)

    def read(self, version: int | None = None, keep_version: bool = False,
             since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Rows of a version (the current one by default); missing columns read as NULL.

        ``keep_version`` keeps ``_v``, the version that added the row. Rows of ``since`` to
        ``until``, both inclusive, need a layout: rows without a time are in no span.
        """
        if self.layout is None and (since or until):
            raise ValueError("a span of time needs a table with a layout")
        commits = self._commits()
        current = commits[-1].version if commits else 0
        version = current if version is None else version
        if version > current:
            raise ValueError(f"version {version} does not exist (current: {current})")
        if version <= 0:
            return self.spark.createDataFrame([], T.StructType([]))
        live = self._live(commits, version)
        # Vacuum removes the oldest folder of a version first.
        if not exists(self.spark, f"{self.root}/data/{live[0].folder}"):
            raise ValueError(f"version {version} has been vacuumed")
        rows = self._rows(self._fields(live), [r.folder for r in live], since, until)
        if not keep_version:
            return rows.drop("_a")
        added = self.spark.createDataFrame([(r.folder.removeprefix("_a="), r.version) for r in live], "_a string, _v bigint")
        return rows.join(F.broadcast(added), "_a").drop("_a")

    def read_as_of(self, ts: datetime) -> DataFrame:
        return self.read(self.version_as_of(ts))

    def read_batch(self, version: int) -> DataFrame:
        """Only the rows that ``version`` added."""
        commit = [r for r in self._commits() if r.version == version]
        return self._rows(self._fields(commit), [commit[0].folder]).drop("_a")

    def changes(self, since: int, until: int) -> DataFrame:
        """Rows that ``until`` has and ``since`` has not or the other way round: columns, ``change``, ``copies``.

        Folders that both versions share are not read. The others are a multiset difference:
        rows meet by two 64-bit digests of all columns, each copy of ``until`` counting one up
        and each of ``since`` one down, combined map-side, so many copies move as one row per task. Columns
        that a version doesn't have count as null.
        """
        commits = self._commits()
        if max(since, until) > (commits[-1].version if commits else 0):
            raise ValueError(f"there is no version {max(since, until)}")
        live = [self._live(commits, v) for v in (since, until)]
        known = sorted([*live[0], *live[1]], key=lambda r: r.version)
        fields = self._fields(known) if known else []
        schema = T.StructType([*fields, T.StructField("change", T.StringType()), T.StructField("copies", T.LongType())])
        shared = {r.folder for r in live[0]} & {r.folder for r in live[1]}
        sides = []
        for rows, sign in zip(live, (-1, 1)):
            folders = [r.folder for r in rows if r.folder not in shared]
            if folders:
                sides.append(self._rows(fields, folders).drop("_a").withColumn("_sign", F.lit(sign)))
        if not sides:
            return self.spark.createDataFrame([], schema)
        both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        names = [f.name for f in fields]
        row = F.struct(*[F.col(f"`{n}`") for n in names])
        # Nulls are skipped by the hash: which columns are null is hashed with the values.
        gaps = F.array(*[F.col(f"`{n}`").isNull() for n in names])
        counted = both.groupBy(F.xxhash64(row, gaps).alias("_a"), F.xxhash64(F.lit("other"), gaps, row).alias("_b")).agg(
            F.any_value(row).alias("_row"), F.sum("_sign").alias("_n")).where(F.col("_n") != 0)
        return counted.select(*[F.col(f"_row.`{n}`").alias(n) for n in names],
                              F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"), F.abs("_n").alias("copies"))

    # -- vacuum ----------------------------------------------------------------------------

    def expired(self, retain_versions: int = 10) -> DataFrame:
        """Versions whose rows no retained version can reach."""
        if retain_versions < 1:
            raise ValueError("at least one version must be retained")
        commits = self._commits()
        live = self._live(commits, max((commits[-1].version if commits else 0) - retain_versions + 1, 1))
        return self.history().where(F.col("version") < (live[0].version if live else 1)).select("version")

    def vacuum(self, retain_versions: int = 10) -> list[int]:
        """Delete the data of expired versions, oldest first, and return them; the commits stay."""
        there = set(names(self.spark, f"{self.root}/data"))
        gone = [r for r in self.history().join(self.expired(retain_versions), "version").select("version", "folder")
                .orderBy("version").collect() if r.folder in there]
        for row in gone:
            remove(self.spark, f"{self.root}/data/{row.folder}")
        return [r.version for r in gone]
