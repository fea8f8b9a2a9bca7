"""Rejected rows, kept per source and batch.

Rows are rejected for what is wrong with them, so their columns may have any type and batches
may disagree. They are stored under one fixed schema, a map of column name to text, and read
back with it: types are given on reading, and text that does not fit one reads as NULL there
while the map still has it. ``body`` is the row once more as a VARIANT, with the types it came
with, nested ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerloom.operators.payloads import as_variant
from ledgerloom.schema import TRANSACTION

LETTER = "payload map<string,string>, body variant, source string, batch_id string"


def write_dead_letters(rejected: DataFrame, root: str, source: str, batch_id: str) -> str:
    """Write a batch's rejected rows to its own partition and return that path.

    A repeated batch replaces its own partition, and no two batches share one.
    """
    path = f"{root.rstrip('/')}/source={source}/batch_id={batch_id}"
    cells = [x for c in rejected.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    rejected.select(F.create_map(*cells).alias("payload"), as_variant(rejected).alias("body")).write.mode("overwrite").parquet(path)
    return path


def read_dead_letters(spark: SparkSession, root: str, schema: T.StructType = TRANSACTION) -> DataFrame:
    """All dead letters: the columns of ``schema``, ``payload``, ``body``, ``source`` and ``batch_id``."""
    rows = spark.read.schema(LETTER).parquet(root)
    return rows.select(*[F.col("payload")[f.name].try_cast(f.dataType).alias(f.name) for f in schema],
                       "payload", "body", "source", "batch_id")
