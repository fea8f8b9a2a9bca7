"""Deliveries of the stream queries: many files, one micro-batch each."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom import queries
from ledgerloom.schema import TRANSACTION


def test_a_delivery_is_written_by_many_tasks_and_read_as_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ROWS_PER_FILE", 50, raising=False)
    rows = spark.range(400).select(*[
        F.col("id").alias(f.name) if f.name == "block_number"
        else F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias(f.name) if f.name == "timestamp"
        else F.lit("1").cast(f.dataType).alias(f.name) for f in TRANSACTION.fields])
    parts = [rows, rows.where("false"), rows.where("block_number < 3"), rows.where("block_number >= 100"), rows.where("block_number = 7")]
    stream = queries._deliveries(spark, parts, 400)
    found = []

    def load(batch, number):
        found.append((batch.count(), batch.select("_file").distinct().count()))

    stream.withColumn("_file", F.input_file_name()).writeStream.foreachBatch(load).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in found if n] == [400, 3, 300, 1]
    assert [f for n, f in found if n >= 300] == [9, 9]  # so no task writes or reads a whole delivery
