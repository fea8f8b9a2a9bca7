"""Streaming ingest with the contract split, and streaming deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.contracts import Contract, accepted, rejected
from ledgerloom.operators.drift import normalize
from ledgerloom.plans.snapshots import SnapshotTable
from ledgerloom.schema import TIME, TRANSACTION
from ledgerloom.sources.dead_letters import write_dead_letters


REPORT = """position int, rule string, passed boolean, details map<string,double>, note string, total_records bigint,
            source string, batch_id string"""


def read_stream(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION,
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of ``path`` as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest_stream(stream: DataFrame, root: str, name: str, checkpoint: str,
                  available_now: bool = True, interval: str = "1 minute", contract: Contract | None = None) -> StreamingQuery:
    """Append each micro-batch's clean rows to ``transactions``, its others to ``dead_letters``
    and the report of its contract to ``reports``, all below ``root``.

    The checkpoint is the high-water mark. Commits are keyed by stream name and batch number,
    so a batch replayed after a failure is not added twice; use a new name with a new
    checkpoint.
    """
    contract = contract or Contract(name)

    def load(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        batch_id = f"{name}-{number:012d}"
        batch = normalize(rows.persist())  # every step below reads it; the source is read once
        contract.report(batch).write.mode("overwrite").parquet(f"{root}/reports/source={name}/batch_id={batch_id}")
        write_dead_letters(batch.where(rejected(batch)), f"{root}/dead_letters", name, batch_id)
        SnapshotTable(spark, f"{root}/transactions").write(batch.where(accepted(batch)), batch_id=batch_id)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """The rule reports of all micro-batches, with ``source`` and ``batch_id``."""
    return spark.read.schema(REPORT).parquet(f"{root}/reports")


def deduplicate_stream(stream: DataFrame, keys: list[str], delay: str, time: str = TIME) -> DataFrame:
    """First row of each key seen within ``delay`` of its time.

    Unlike the batch operator this keeps the first arrival, and only within the watermark
    delay, which bounds the state. Rows without a key or time are dropped first: the contract
    rejects them, and a null key would gather in one task. Streams need zoned timestamps, so
    the time column becomes TIMESTAMP.
    """
    rows = stream
    for c in [*keys, time]:
        rows = rows.where(F.col(c).isNotNull())
    return (rows.withColumn(time, F.col(time).cast("timestamp"))
            .withWatermark(time, delay)
            .dropDuplicatesWithinWatermark(keys))
