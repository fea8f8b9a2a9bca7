"""Which keys earlier batches have loaded, without joining every batch with the whole table.

Each version of a table leaves a blocked Bloom filter of its keys: a key belongs to one block of
32,768 bits and sets ``BITS`` of them. Filters of any versions merge block by block with OR, and
after ``merge_every`` of them they are merged into one. A batch is joined with the blocks; only keys all of
whose bits are set are looked up among the table's keys, so the result is exact and the
lookup is of the size of the repeated keys and about one in a hundred of the others. With more than
about 3,300 keys in a block more keys are looked up, never fewer: ask for more blocks then and
let the filters be made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.plans.snapshots import SnapshotTable
from ledgerloom.session import stage

BLOCK = 32_768      # bits of a bitmap of the bitmap functions
BITS = 7
BLOCKS = 4_096      # room for 13 million keys at ten bits each
FILTER = "block bigint, bits binary"


def place(key: str, blocks: int) -> tuple[Column, Column]:
    """(block, positions) of a key."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    other = F.xxhash64(F.lit("place"), F.col(key))
    first, step = F.pmod(other, F.lit(BLOCK)), F.pmod(F.shiftright(other, 20), F.lit(BLOCK)).bitwiseOR(F.lit(1))
    return block, F.array(*[(first + step * i) % BLOCK for i in range(BITS)])


def key_filter(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bits) of the non-null keys; bits of a block are combined in each task first."""
    block, positions = place(key, blocks)
    return (df.where(F.col(key).isNotNull()).select(block.alias("block"), F.explode(positions).alias("at"))
            .groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")))


def merge_filters(parts: DataFrame) -> DataFrame:
    return parts.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _is_set(bits: str, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)) > 0


class SeenKeys:
    """Filters of a table's versions below ``root``."""

    def __init__(self, spark: SparkSession, root: str, table: SnapshotTable, key: str,
                 blocks: int = BLOCKS, merge_every: int = 24):
        self.spark = spark
        self.filters = SnapshotTable(spark, root)
        self.table = table
        self.key = key
        self.blocks = blocks
        self.merge_every = merge_every

    def catch_up(self) -> None:
        """Add the filters of versions that have none yet, such as one whose run failed after its commit.

        An overwrite brings rows of its own: all its keys are new to the filters.
        """
        done = self.filters.history().where("batch_id IS NOT NULL").select(F.col("batch_id").cast("bigint").alias("version"))
        missing = self.table.history().join(done, "version", "left_anti").select("version").orderBy("version").collect()
        for row in missing:
            self.filters.write(key_filter(self.table.read_batch(row.version), self.key, self.blocks), "append", None, str(row.version))
        if self.filters.live_commits() > self.merge_every:
            self.filters.write(merge_filters(self.filters.read()), "overwrite")

    def maybe(self, df: DataFrame) -> DataFrame:
        """Keys of ``df`` whose bits are all set: every key that was loaded, and few others."""
        if not self.filters.version:
            return df.select(self.key).limit(0)
        block, positions = place(self.key, self.blocks)
        # A key that repeats is joined once.
        keys = df.where(F.col(self.key).isNotNull()).select(self.key).distinct().select(self.key, block.alias("block"), positions.alias("at"))
        known = merge_filters(self.filters.read())
        return keys.join(known, "block").where(F.forall("at", lambda p: _is_set("bits", p))).select(self.key)

    def split(self, df: DataFrame) -> tuple[DataFrame, int, int]:
        """(rows whose key the table does not have, keys looked up, keys found). Rows without a key are kept."""
        self.catch_up()
        asked = stage(self.maybe(df), "maybe-seen")
        n = asked.count()
        if not n:
            return df, 0, 0
        found = stage(self.table.read().select(self.key).join(asked, self.key, "left_semi").distinct(), "seen")
        return df.join(found, self.key, "left_anti"), n, found.count()
