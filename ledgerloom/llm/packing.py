"""Best-fit packing with bounds that certify it.

Pieces are dealt into groups, each group is packed best-fit decreasing, and a lower bound from
dual feasible functions says how many bins its pieces need at least. A group that reaches its
bound is certified and final. The others give up their bins that are not full; those pieces
are dealt out anew, into fewer groups, and packed again. Bins that are full stay. Rounds end
when all groups are certified or ``rounds`` is reached. Every piece is always placed.

Defined results: a null text counts as empty and is a document of its end token alone. Rows
that repeat, ids that repeat and null ids are packed like any other. A piece of length 0
takes offset 0 of a bin of its own group. An empty table gives an empty result. Other columns
are not touched.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.tokens import encoder
from ledgerloom.session import stage

GROUP = 65_536      # pieces packed together at most; bounds a task's memory


def pieces_of(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = 2048,
              end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents in tokens, those over ``capacity`` cut."""
    kind = df.schema[id_col].dataType

    def task(batches):
        for batch in batches:
            table = pa.table(batch)
            texts, rows = table.column(1).to_pylist(), ([], [], [], [], [])
            end = np.array([end_id], dtype="<u4").tobytes()
            for k, ids in enumerate(encoder(tokenizer).encode(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(rows, (k, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            ids_of = table.column(0).combine_chunks().take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_of, pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:]]],
                names=[id_col, "piece", "start", "length", "ids_crc32"])

    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    schema = StructType([StructField(id_col, kind), StructField("piece", IntegerType()),
                         *[StructField(n, LongType()) for n in ("start", "length", "ids_crc32")]])
    return df.select(id_col, text).mapInArrow(task, schema)


# -- one group -----------------------------------------------------------------------------

def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, longest first into the fullest bin that takes it; bins used."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0  # bit r of open_rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = open_rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        by_room[room - need].append(b)
        open_rooms |= 1 << (room - need)
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 20) -> int:
    """Bins that any packing needs: the best of three families of dual feasible functions.

    A function f with sum f(x) <= 1 over every set that fits into one bin turns the total of f
    into a bound. Used: the identity; the step functions floor((k + 1) x) / k; and those that
    round pieces over 1 - e up to 1 and drop pieces under e.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, most_k + 1):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # f(x) k capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    fewer, total = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    large = fewer[-1] - fewer[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = max(best, int((large + -(-middle // capacity)).max()), int(count[capacity // 2 + 1:].sum()))
    return best


def _pack(df: DataFrame, capacity: int, groups: int, last: bool) -> DataFrame:
    """Deal rows of ``df`` into groups and pack each; adds bin, offset and whether the place is final.

    Rows are dealt by all that tells them apart; more than ``GROUP`` rows that are all equal are
    still packed in groups of that many.
    """
    names = df.columns

    def task(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        kept, rows, number = [], 0, 0

        def packed(table: pa.Table):
            nonlocal number
            lengths = table.column("length").to_numpy()
            bins, offsets, used = best_fit(lengths, capacity)
            certified = used == lower_bound(lengths, capacity)
            filled = np.bincount(bins, weights=lengths, minlength=used)
            final = np.full(len(lengths), True) if last or certified else filled[bins] >= capacity
            out = table.append_column("bin", pa.array(bins + (np.int64(part) << 32) + number)) \
                .append_column("offset", pa.array(offsets)).append_column("final", pa.array(final))
            number += used
            return out.combine_chunks().to_batches()

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, GROUP - rows)
                batch = batch.slice(some.num_rows)
                kept.append(some)
                rows += some.num_rows
                if rows == GROUP:
                    yield from packed(pa.Table.from_batches(kept))
                    kept, rows = [], 0
        if rows:
            yield from packed(pa.Table.from_batches(kept))

    from pyspark.sql.types import BooleanType, LongType, StructField, StructType
    schema = StructType([*df.schema.fields, StructField("bin", LongType()), StructField("offset", LongType()),
                         StructField("final", BooleanType())])
    return df.repartition(groups, *names).mapInArrow(task, schema)


def pack(items: DataFrame, capacity: int = 2048, rounds: int = 3) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Columns named sequence_id, offset, bin or final are replaced or dropped. ``items`` are scanned once; what each round leaves is written to the shared folder. The
    number of groups follows the number of rows. Sequence numbers say the round, the group and
    the bin, so they never meet.
    """
    items = items.drop("sequence_id", "offset", "bin", "final")
    left, done = items, None
    n = items.count()
    for turn in range(rounds):
        groups = max(1, -(-n // GROUP))
        out = stage(_pack(left, capacity, groups, turn == rounds - 1), "packed")
        placed = out.where("final").select(
            *items.columns, (F.col("bin") + F.lit(turn) * F.lit(1 << 56)).alias("sequence_id"), "offset")
        done = placed if done is None else done.unionByName(placed)
        left = out.where(~F.col("final")).select(*items.columns)
        n = left.count()
        if n == 0:
            break
    return done


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = 2048,
                   end_id: int = 0, rounds: int = 3) -> DataFrame:
    """One row per piece of each document with its place: see ``pieces_of`` and ``pack``."""
    return pack(stage(pieces_of(docs, tokenizer, id_col, text, capacity, end_id), "pieces"), capacity, rounds)
