"""Rows that share a key, met in sorted partitions instead of in groups.

``groupBy().applyInPandas`` pays for every group; with millions of small groups that is all
the cost there is. Here rows are dealt out by key and sorted, and a task walks over the runs
of equal keys. Keys with more rows than ``BLOCK`` are first dealt out as pairs of blocks, so
that no task holds more than two blocks of a key and every two rows of it still meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 4096


def split_hot(df: DataFrame, item: str, block: int = BLOCK) -> DataFrame:
    """Add ``_part``: 0, or for keys with over ``block`` rows one value per pair of blocks.

    A row of a key with b blocks comes b times, once for each block its own is paired with.
    The keys that need it are counted by one aggregate; they are few and joined as such.
    """
    hot = df.groupBy("key").count().where(F.col("count") > block).select(
        "key", F.ceil(F.col("count") / block).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(F.lit(7), item), F.col("_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1),
                        lambda o: F.least(own, o) * F.col("_blocks") + F.greatest(own, o))
    return (df.join(hot, "key", "left")
            .withColumn("_part", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)))
            .drop("_blocks"))


def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as arrays: numbers as they are, lists of equal length as matrices, the rest as objects."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of equal ``keys`` in sorted batches, each as a dict of arrays."""
    waiting: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        if len(waiting) == 1:
            return waiting[0]
        return {n: np.concatenate([w[n] for w in waiting]) for n in waiting[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns_of(batch)
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            piece = {n: c[a:b] for n, c in cols.items()}
            if a == 0 and waiting and any(waiting[-1][k][-1] != piece[k][0] for k in keys):
                yield joined()
                waiting = []
            elif a:
                yield joined()
                waiting = []
            waiting.append(piece)
    if waiting:
        yield joined()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of sorted batches, cut between runs of equal ``keys`` only, and where runs begin, and the end.

    Some runs come at a time, of ``rows`` rows or more in all but the last time.
    """
    waiting: list[dict[str, np.ndarray]] = []
    held = 0

    def joined() -> tuple[dict[str, np.ndarray], np.ndarray]:
        cols = {n: np.concatenate([w[n] for w in waiting]) for n in waiting[0]}
        change = np.zeros(held - 1, dtype=bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        return cols, np.array([0, *(np.flatnonzero(change) + 1).tolist(), held])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns_of(batch)
        if held >= rows and any((cols[k] != waiting[-1][k][-1]).any() for k in keys):
            # Up to where the last run that waits ends.
            other = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                other |= cols[k] != waiting[-1][k][-1]
            at = int(other.argmax())
            waiting.append({n: c[:at] for n, c in cols.items()})
            held += at
            yield joined()
            waiting, held = [], 0
            cols = {n: c[at:] for n, c in cols.items()}
        waiting.append(cols)
        held += len(cols[keys[0]])
    if waiting:
        yield joined()


def over_runs(df: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray]], list | None], schema: str,
              partitions: int | None = None) -> DataFrame:
    """Apply ``fn`` to each run of ``keys``; it returns arrays in the order of ``schema`` or None."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def task(batches):
        ready, rows = [], 0
        for run in runs(batches, keys):
            made = fn(run)
            if made is None or not len(made[0]):
                continue
            ready.append(made)
            rows += len(made[0])
            if rows >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready)], names=names)
                ready, rows = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready)], names=names)

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


def stars(items: np.ndarray, alike: Callable[[np.ndarray, int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Connect the items of one run: (smallest item of the component, member) for every member but itself.

    ``items`` are distinct. ``alike(items, i, rest)`` says which of the positions ``rest`` are
    linked to position i. Work is all comparisons in the worst case, output never more than a
    row per item.
    """
    if len(items) == 1:
        return items[:0], items[:0]
    order = np.argsort(items, kind="stable")
    rest = order
    roots, members = [], []
    while len(rest) > 1:
        start, rest = rest[0], rest[1:]
        todo = [start]
        while todo and len(rest):
            near = alike(items, todo.pop(), rest)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found.tolist())
                members.append(items[found])
                roots.append(np.repeat(items[start:start + 1], len(found)))
    if not members:
        return items[:0], items[:0]
    return np.concatenate(roots), np.concatenate(members)
