"""What is known of each entity, carried from batch to batch.

A window adds one part: per entity the first and last time, count, mean and squared deviations
of its amounts, and how often each chain and token occurred. Parts merge in any number, so the
state before a window is the merge of the parts written before it, and a window's work is of
the size of the window and of the state of its entities, not of the history. After ``MERGE_EVERY``
parts they are merged into one.
"""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators.chunks import MOMENTS, combine, fold
from ledgerloom.operators.features import MODES, Prior
from ledgerloom.operators.ranks import value_counts
from ledgerloom.plans.snapshots import SnapshotTable
from ledgerloom.schema import ENTITY, TIME
from ledgerloom.session import together

FACTS = f"{ENTITY} string, first_time timestamp_ntz, last_time timestamp_ntz, moments {MOMENTS}"
COUNTS = f"{ENTITY} string, name string, value string, n bigint"
MERGE_EVERY = 24


def facts_of(rows: DataFrame, amount: str = "amount_usd") -> DataFrame:
    """One row per entity; combined map-side, so a hot entity moves one row per task."""
    return rows.where(F.col(ENTITY).isNotNull()).groupBy(ENTITY).agg(
        F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"), fold("moments", F.col(amount)).alias("moments"))


def merge_facts(parts: DataFrame) -> DataFrame:
    """One row per entity from any parts; an entity has at most one row per part."""
    merged = F.aggregate(F.collect_list("moments"), F.lit(None).cast(MOMENTS), lambda a, b: combine("moments", a, b))
    return parts.groupBy(ENTITY).agg(F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), merged.alias("moments"))


def counts_of(rows: DataFrame) -> DataFrame:
    """How often each value of the columns with modes occurs per entity."""
    return value_counts(rows.where(F.col(ENTITY).isNotNull()), [ENTITY], MODES)


def merge_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy(ENTITY, "name", "value").agg(F.sum("n").alias("n"))


class EntityState:
    """The parts below ``root``. A part is keyed by its batch: writing it again is a no-op."""

    def __init__(self, spark: SparkSession, root: str, merge_every: int = MERGE_EVERY):
        self.spark = spark
        self.facts = SnapshotTable(spark, f"{root.rstrip('/')}/facts")
        self.counts = SnapshotTable(spark, f"{root.rstrip('/')}/counts")
        self.merge_every = merge_every

    def before(self, batch_id: str, start: datetime, entities: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(facts, counts) of ``entities`` from all rows before ``start``.

        A batch that has its part already gets the state from before that. If later windows
        have been loaded, their parts can't be taken out again: the state is then made from
        ``rows``, those of the table.
        """
        last = [self._last(t, batch_id) for t in (self.facts, self.counts)]
        until = self.facts.history().where(F.col("version") <= last[0]).agg(
            F.max(F.col("metadata")["until"].cast("timestamp_ntz"))).first()[0]
        if until is not None and until > start:
            earlier = rows.where(F.col(TIME) < F.lit(start).cast("timestamp_ntz")).join(entities, ENTITY, "left_semi")
            return facts_of(earlier), counts_of(earlier)
        facts, counts = (self._read(t, v, schema).join(entities, ENTITY, "left_semi")
                         for t, v, schema in zip((self.facts, self.counts), last, (FACTS, COUNTS)))
        return merge_facts(facts), merge_counts(counts)

    def _last(self, table: SnapshotTable, batch_id: str) -> int:
        done = table.batch_version(batch_id)
        return table.version if done is None else done - 1

    def _read(self, table: SnapshotTable, version: int, schema: str) -> DataFrame:
        return table.read(version) if version else self.spark.createDataFrame([], schema)

    def record(self, batch_id: str, rows: DataFrame, until: datetime) -> None:
        """Add the part of a batch; ``rows`` are those it loaded."""
        def add(table: SnapshotTable, part: DataFrame, merge) -> None:
            table.write(part, "append", {"until": until.isoformat()}, batch_id)
            if table.live_commits() >= self.merge_every:
                table.write(merge(table.read()), "overwrite", {"until": until.isoformat()})

        together(self.spark, partial(add, self.facts, facts_of(rows), merge_facts), partial(add, self.counts, counts_of(rows), merge_counts))
