"""Resampling toward a target distribution by hashed n-gram weights.

Words of whole texts make features, runs of 1 to ``runs`` consecutive words; a feature's bucket
is the crc32 of its bytes modulo ``buckets``. A bucket's gain says how much likelier it is in the target texts
than in the documents, in thousandths of a natural logarithm, and a document's weight is the
floored mean of the gains of its features. Adding seeded Gumbel noise to weights and taking the
highest scores is a draw without replacement (importance resampling, Xie and others, 2023).

Texts are read once: packed bucket numbers are written to the shared folder, counted bucket by
bucket before anything is shuffled, and scored by an array of gains. The cutoff comes from a
quantile sketch of the scores: exact counts of the rows above and inside a bracket around it
tell whether the cutoff lies inside, and the bracket is widened until it does. Only the bracket is sorted to find the
cutoff. Rows above it are drawn whatever their order; they are sorted to number them.

Defined results: null and empty texts have no features and weight 0. Rows that repeat are drawn
on their own; equal scores go to the smaller id, nulls last, and rows equal in both are numbered
in any order. An id that is null is hashed as the word null. Other columns are never read.
Without target texts all gains come from the documents alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.session import stage

SLICE = 1 << 20             # bytes of a text split into words at once
SKETCH = 4096               # size of the quantile sketch: ranks within about 0.1%
ERROR = 0.002               # half the first bracket, as a share of the rows

# Lower-cases A-Z; all ASCII but digits and letters becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Draw:
    """Parameters of a draw: ``percent`` of the documents with at least ``least_words`` words."""

    runs: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def bucket_numbers(text: bytes | None, runs: int = 1, buckets: int = 10_000) -> tuple[int, np.ndarray]:
    """Number of words of a whole text, and the buckets of its features."""
    data = (text or b"").translate(_FOLD)
    words, found, last, at = 0, [], [], 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        some = data[at:end].split()
        at, words = end, words + len(some)
        found.append(np.fromiter(map(zlib.crc32, some), np.uint32, len(some)))
        joined = last + some
        for n in range(2, runs + 1):
            # Runs that end in this slice, also those that begin in the one before.
            ends = range(max(n, len(last) + 1), len(joined) + 1)
            found.append(np.fromiter((zlib.crc32(b" ".join(joined[e - n:e])) for e in ends), np.uint32, len(ends)))
        last = joined[max(0, len(joined) - runs + 1):] if runs > 1 else []
    return words, (np.concatenate(found) if found else np.zeros(0, np.uint32)) % buckets


def hashed(df: DataFrame, draw: Draw, text: str = "text", id_col: str | None = None) -> DataFrame:
    """(id, words, features): packed 32-bit bucket numbers of the features of each text."""
    kept = df.select(F.lit(0).cast("long").alias("id") if id_col is None else F.col(id_col).alias("id"),
                     F.col(text).cast("string").cast("binary").alias("text"))

    def make(batches):
        for batch in batches:
            texts, words, features, held, start = batch.column(1), [], [], 0, 0
            for at in range(batch.num_rows):
                n, found = bucket_numbers(texts[at].as_py(), draw.runs, draw.buckets)
                words.append(n)
                features.append(found.astype("<u4").tobytes())
                held += len(features[-1])
                if held > 1 << 26 or at == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(words)), pa.array(words, pa.int64()), pa.array(features, pa.binary())],
                                                     names=["id", "words", "features"])
                    start, words, features, held = at + 1, [], [], 0

    return kept.mapInArrow(make, f"id {kept.schema['id'].dataType.simpleString()}, words long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, added up in each task first: at most ``buckets`` rows from a task, and as many here."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, from its counts in the documents and in the target texts."""
    s_all, t_all, k = int(documents.sum()), int(target.sum()), len(documents)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + k)) / ((s + 1) * (t_all + k))))
                     for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def noise(key: object, seed: int) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, draw: Draw) -> DataFrame:
    """(id, words, n_features, weight, score, place); the place tells equal rows apart once written."""
    kind = features.schema["id"].dataType.simpleString()

    def score(batches):
        context, row = TaskContext.get(), 0
        first = context.partitionId() << 36 if context else 0
        for batch in batches:
            n, weight, total = [], [], []
            for key, packed in zip(batch.column(0), batch.column(2)):
                found = np.frombuffer(packed.as_py(), "<u4")
                n.append(len(found))
                weight.append(int(gain[found].sum()) // len(found) if len(found) else 0)
                total.append(weight[-1] + noise(key.as_py(), draw.seed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (n, weight, total)],
                 pa.array(np.arange(first + row, first + row + batch.num_rows))],
                names=["id", "words", "n_features", "weight", "score", "place"])
            row += batch.num_rows

    return features.mapInArrow(score, f"id {kind}, words long, n_features long, weight long, score long, place long")


def numbered(rows: DataFrame, after: int, name: str) -> DataFrame:
    """Add ``rank``: the place in the order of scores, from ``after`` + 1.

    Rows are dealt to partitions by ranges of the order and written; a partition's first rank
    comes from the counts of those before it, one number per partition.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("place")]
    dealt = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    sizes = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, at = [], after
    for part, n in sizes:
        starts.append((part, at))
        at += n
    known = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return dealt.join(F.broadcast(known), "part").withColumn(
        "rank", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).drop("part", "start")


def bracket(scores: DataFrame, sketch: bytes, rows: int, wanted: int, error: float = ERROR) -> tuple[int, int, int]:
    """(low, high, rows above high) such that the ``wanted``-th highest score lies in [low, high]."""
    held, share = scores.sparkSession.createDataFrame([(sketch,)], "sketch binary"), wanted / rows
    while True:
        low, high = held.select(*[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(at)))
                                  for at in (max(0.0, 1 - share - error), min(1.0, 1 - share + error))]).first()
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < wanted <= above + inside:
            return low, high, above
        error *= 4


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), id_col: str = "doc_id", text: str = "text",
             error: float = ERROR) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn."""
    features = stage(hashed(docs, draw, text, id_col), "features")
    gain = gains(bucket_counts(features, draw.buckets), bucket_counts(hashed(target, draw, text), draw.buckets))
    rows = stage(scored(features, gain, draw), "scores")
    eligible = rows.where(F.col("words") >= draw.least_words)
    n, sketch = eligible.agg(F.count("*"), F.kll_sketch_agg_bigint("score", SKETCH)).first()
    wanted = draw.percent * n // 100
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*columns, undrawn)
    low, high, above = bracket(eligible, bytes(sketch), n, wanted, error)
    inside = numbered(eligible.where(F.col("score").between(low, high)), above, "bracket")
    # The cutoff is the last row drawn from the bracket.
    inside = inside.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    drawn = numbered(eligible.where(F.col("score") > high), 0, "drawn")
    rest = rows.where((F.col("words") < draw.least_words) | (F.col("score") < low))
    return inside.select(*columns, "rank").unionByName(drawn.select(*columns, "rank")).unionByName(rest.select(*columns, undrawn))
