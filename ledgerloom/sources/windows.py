"""Time-window extracts from parquet sources, and their high-water marks."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators.drift import normalize
from ledgerloom.schema import TIME
from ledgerloom.sources.files import create, names, remove

STAMP = "%Y%m%dT%H%M%S%f"


@dataclass(frozen=True)
class SourceConfig:
    """A named source: parquet location and the chains it contributes (all if empty).

    ``day_column`` names the partition column that holds the day of a row, if the location is
    laid out by day: windows then list and open only the folders they need.
    """

    name: str
    path: str = ""
    chains: list[str] = field(default_factory=list)
    day_column: str | None = None


def default_sources(root: str, day_column: str | None = "day") -> list[SourceConfig]:
    """The standard sources below ``root``, one folder each, laid out by day."""
    # Source names and the chain each one carries.
    chains = {
        "ethereum_mainnet": ["ethereum"],
        "bitcoin_mainnet": ["bitcoin"],
        "polygon_matic": ["polygon"],
        "solana_mainnet": ["solana"],
    }
    return [SourceConfig(n, f"{root.rstrip('/')}/{n}", c, day_column) for n, c in chains.items()]


def in_window(df: DataFrame, start: datetime, end: datetime, time: str = TIME) -> DataFrame:
    """Rows with ``start <= time < end``: adjacent windows share no row."""
    at = F.col(time)
    return df.where((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))


def extract_window(source: SourceConfig, start: datetime, end: datetime,
                   records: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
    """One source's rows of the window, tagged with its name.

    Reads ``source.path`` unless ``records`` is given. Time and chain conditions reach the
    parquet scan.
    """
    if records is None:
        spark = spark or SparkSession.active()
        records = spark.read.parquet(source.path)
    rows = in_window(records, start, end)
    if source.day_column and source.day_column in rows.columns:
        last = end - timedelta(microseconds=1)
        rows = rows.where(F.col(source.day_column).cast("date").between(F.lit(start.date()), F.lit(last.date())))
    if source.chains:
        rows = rows.where(F.col("chain").isin(source.chains))
    return rows.withColumn("_source", F.lit(source.name))


def extract_incremental(source: SourceConfig, end: datetime, last_mark: datetime | None = None,
                        window_minutes: int = 60, records: DataFrame | None = None) -> DataFrame:
    """Rows since the mark, or of the last ``window_minutes`` without one, up to ``end``."""
    start = last_mark if last_mark is not None else end - timedelta(minutes=window_minutes)
    return extract_window(source, start, end, records)


def extract_all(sources: list[SourceConfig], start: datetime, end: datetime,
                records: DataFrame | None = None) -> DataFrame:
    """Every source's rows of one window, united by column name and normalized.

    Shared ``records`` are scanned once: a row comes once for each source that takes its chain.
    """
    if records is not None:
        takes = [F.col("chain").isin(s.chains) if s.chains else F.lit(True) for s in sources]
        whose = F.array_compact(F.array(*[F.when(t, F.lit(s.name)) for s, t in zip(sources, takes)]))
        rows = in_window(records, start, end).where(reduce(lambda a, b: a | b, takes))
        return normalize(rows.withColumn("_source", F.explode(whose)))
    parts = [extract_window(s, start, end, records) for s in sources]
    return normalize(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def _marks(spark: SparkSession, path: str, source: str) -> list[tuple[datetime, str]]:
    """The marks of a source: each is a file named by the source and the end it has reached."""
    lead = f"{quote(source, safe='')}@"
    return sorted((datetime.strptime(n.removeprefix(lead), STAMP), n) for n in names(spark, path) if n.startswith(lead))


def read_mark(spark: SparkSession, path: str, source: str) -> datetime | None:
    """Latest window end recorded for the source."""
    marks = _marks(spark, path, source)
    return marks[-1][0] if marks else None


def advance_mark(spark: SparkSession, path: str, source: str, end: datetime) -> None:
    """Record that the source is loaded up to ``end``; repeating it changes nothing.

    Marks before the latest are deleted, so their number does not grow.
    """
    create(spark, f"{path}/{quote(source, safe='')}@{end.strftime(STAMP)}", "")
    for _, name in _marks(spark, path, source)[:-1]:
        remove(spark, f"{path}/{name}")
