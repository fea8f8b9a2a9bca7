"""Quality classifier: random Fourier features on document statistics, ridge scores, isotonic calibration.

Statistics of the whole text are standardised and mapped to cosines of random projections,
whose inner products approximate a Gaussian kernel (Rahimi and Recht, 2007). Each task sums
the normal equations of its labelled rows; the driver adds a fixed number of such sums and
solves the ridge system. Scores of labelled rows that were not used for that are averaged by
ranges of the score and made monotone (pool adjacent violators): that maps a score to the
share of label 1.

Only labelled rows train, all of them: every statistic is of a row, so the sums have the size
of the features, not of the data. Defined results: a null text counts as empty and gets the
score that the model has for an empty text. Labels that are null or not 0 or 1 are left out;
rows that repeat count as often as they come. Rows with a null id are scored and never train.
Without labels of both kinds every score is the share of label 1, or 0.5. An empty table gives
an empty result. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.session import stage

STATISTICS = ["log_words", "word_length", "upper", "digit", "space", "bar", "bang", "symbol", "point", "distinct", "repeated",
              "lines", "distinct_lines", "long_words", "marked_words", "non_ascii", "shouting_lines"]
SUMS = 32               # tasks that sum normal equations
BINS = 2000             # ranges of the raw score for the calibration
_MARKS = [b"#", b"$", b"%", b"&", b"*", b"!", b"|"]
_SYMBOLS, _POINTS = b"#$%&*@^~=+_<>{}[]\\/`", b".,;:"


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all zero for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    # Bytes of a kind are counted by deleting them.
    kept = lambda kind: size - len(data.translate(None, kind))
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    marked = sum(data.count(mark + end) for mark in _MARKS for end in (b" ", b"\n"))
    return [
        float(np.log1p(n)), float(lengths.mean()), kept(_UPPER) / size, kept(b"0123456789") / size, kept(b" \t\n\r\x0b\x0c") / size,
        kept(b"|") / n, kept(b"!?") / n, kept(_SYMBOLS) / n, kept(_POINTS) / n, len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, float(np.log1p(n / len(lines))), len(set(lines)) / len(lines),
        float((lengths > 15).mean()), marked / n, len(data.translate(None, _ASCII)) / size,
        sum(x.isupper() for x in lines) / len(lines)]


_UPPER = bytes(range(65, 91))
_ASCII = bytes(range(128))


def described(df: DataFrame, text: str = "text", out: str = "_stats") -> DataFrame:
    @F.pandas_udf("array<double>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])
    return df.withColumn(out, compute(F.col(text)))


@dataclass
class Model:
    """A fitted classifier; ``score`` maps statistics to the chance of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw_at: np.ndarray
    chance_at: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.raw_at, self.chance_at)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values``: pool adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(labelled: DataFrame, waves: int = 192, bandwidth: float = 4.0, ridge: float = 1.0, seed: int = 11) -> Model:
    """Fit on rows (_stats, _label in 0 or 1, _fold: true for calibration)."""
    k = len(STATISTICS)
    rng = np.random.default_rng(seed)
    frequencies, phases = rng.normal(size=(k, waves)) / bandwidth, rng.random(waves) * 2 * np.pi
    training = labelled.where(~F.col("_fold"))
    moments = training.agg(F.count("*"), F.sum("_label"), *[f(F.col("_stats")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    n, ones = moments[0], moments[1] or 0
    if n == 0 or ones in (0, n):
        share = float(ones) / n if n else 0.5
        return Model(np.zeros(k), np.ones(k), frequencies, phases, np.zeros(waves + k + 1), np.array([0.0]), np.array([share]))
    mean = np.array(moments[2::2], float)
    scale = np.maximum(np.array(moments[3::2], float), 1e-6)
    model = Model(mean, scale, frequencies, phases, np.zeros(waves + k + 1), np.zeros(1), np.zeros(1))

    def sums(batches):
        total = np.zeros((waves + k + 1, waves + k + 2))
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(float)
                total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = training.select("_stats", "_label").repartition(SUMS).mapInArrow(sums, "total binary").collect()
    total = sum(np.frombuffer(r[0]).reshape(waves + k + 1, -1) for r in parts)
    model.weights = np.linalg.solve(total[:, :-1] + ridge * np.eye(waves + k + 1), total[:, -1])

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch.column(0)))
                at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(batch.column(1).to_numpy().astype(float)), pa.array(raw)],
                                                 names=["bin", "label", "raw"])

    bins = sorted(labelled.where("_fold").select("_stats", "_label").mapInArrow(binned, "bin long, label double, raw double")
                  .groupBy("bin").agg(F.avg("raw"), F.avg("label"), F.count("*")).collect())
    if bins:
        raw, share, weight = (np.array([r[i] for r in bins], float) for i in (1, 2, 3))
        # One row of each kind at the ends keeps small calibration sets from certainty.
        raw = np.concatenate([[min(raw[0], 0.0) - 0.5], raw, [max(raw[-1], 1.0) + 0.5]])
        share, weight = np.concatenate([[0.0], share, [1.0]]), np.concatenate([[1.0], weight, [1.0]])
        model.raw_at, model.chance_at = raw, isotonic(share, weight)
    else:
        model.raw_at, model.chance_at = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def labelled_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows to fit on, of (id, _stats) and (doc_id, quality): remainders 0 and 1 fit, 3 calibrates, 2 is held out."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("_labelled"), F.col("quality").cast("int").alias("_label"))
    part = remainder(id_col)
    return stats.join(known, F.col(id_col) == F.col("_labelled")).where(part != 2).select(
        "_stats", "_label", (part == 3).alias("_fold"))


def scored(df: DataFrame, model: Model, stats: str = "_stats") -> DataFrame:
    """Add ``score``."""
    @F.pandas_udf("double")
    def compute(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), float).reshape(len(rows), -1)))
    return df.withColumn("score", compute(F.col(stats)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for every row. Statistics are made once and written to the shared folder."""
    stats = stage(described(docs.select(F.col(id_col), F.col(text)), text).select(id_col, "_stats"), "statistics")
    model = fit(stage(labelled_rows(stats, labels, id_col), "labelled"))
    return scored(stats, model).select(
        id_col, F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that are predicted good, with all their columns as they are."""
    stats = described(docs.select(F.col(id_col), F.col(text)), text).select(id_col, "_stats")
    model = fit(stage(labelled_rows(stats, labels, id_col), "labelled"))
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), F.col(text).alias("_text"))
    return scored(described(rows, "_text"), model).where(F.col("score") >= threshold).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in columns])
