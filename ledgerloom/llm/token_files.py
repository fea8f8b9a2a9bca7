"""Token ids in binary files of independent zstandard frames with a seek table.

A file holds the ids of its documents, unsigned 32-bit little-endian integers, one document
after the other, in frames that are compressed on their own, of about ``FRAME`` bytes each.
Then follows a skippable frame with the directory (for each document: id, whether the id is
null, number of ids), and last the seek table of the zstandard seekable format: for each frame
its compressed and decompressed size and the low 32 bits of the XXH64 of its content. Any
zstandard tool can decompress the whole file; a reader that wants some documents reads the
end of the file and then only the frames they are in, and checks what it reads.

Files are written by the tasks to a shared folder, under a name of the attempt first and then
renamed, so a task that is repeated leaves one whole file.

Defined results: a null text counts as empty and is a document of its end token alone.
Documents are in ascending id order, null ids first, repeated ids by text. An empty table makes
no document. Other columns are not used.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.tokens import encoder

FRAME = 1 << 18
# Fixed values of the public zstandard seekable format.
SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80


def _store(uri: str):
    """A file system that tasks can use, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class FrameWriter:
    """Writes documents to one open stream."""

    def __init__(self, sink, frame: int = FRAME, level: int = 3):
        import zstandard
        from xxhash import xxh64_intdigest
        self.sink, self.frame, self.hash = sink, frame, xxh64_intdigest
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.waiting, self.size = [], 0
        self.table: list[tuple[int, int, int]] = []
        self.directory: list[bytes] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.directory.append(struct.pack("<qBQ", doc_id or 0, doc_id is None, len(ids) // 4))
        self.ids += len(ids) // 4
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= self.frame:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.waiting)
        for at in range(0, len(data), 4 * self.frame):
            part = data[at:at + 4 * self.frame]
            packed = self.compress(part)
            self.sink.write(packed)
            self.table.append((len(packed), len(part), self.hash(part, 0) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        from zstandard import ZstdCompressor
        directory = ZstdCompressor(level=3).compress(b"".join(self.directory))
        for at in range(0, len(directory), 1 << 30):
            part = directory[at:at + (1 << 30)]
            self.sink.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(part)) + part)
            self.table.append((8 + len(part), 0, self.hash(b"", 0) & 0xFFFFFFFF))
        rows = b"".join(struct.pack("<III", *r) for r in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(rows) + len(footer)) + rows + footer)


class FrameReader:
    """Reads documents of one file; decompresses the frames it needs only."""

    def __init__(self, source):
        import zstandard
        from xxhash import xxh64_intdigest
        self.source, self.hash = source, xxh64_intdigest
        self.decompress = zstandard.ZstdDecompressor().decompress
        end = source.size()
        count, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        self.table = np.frombuffer(source.read_at(12 * count, end - 9 - 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.content = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        packed = b"".join(source.read_at(int(r[0]) - 8, int(a) + 8) for r, a in zip(self.table, self.at) if not r[1])
        found = np.frombuffer(self.decompress(packed), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")]))
        self.doc_ids, self.nulls, self.counts = found["id"], found["null"], found["n"].astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.held: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self.held[0] != k:
            size, whole, check = map(int, self.table[k])
            data = self.decompress(self.source.read_at(size, int(self.at[k])), max_output_size=whole)
            if len(data) != whole or self.hash(data, 0) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, data)
        return self.held[1]

    def read(self, position: int) -> bytes:
        """Ids of the document at a position of the directory."""
        a, b = 4 * int(self.starts[position]), 4 * int(self.starts[position + 1])
        k, out = int(np.searchsorted(self.content, a, side="right")) - 1, []
        while a < b:
            data = self._frame(k)
            low = a - int(self.content[k])
            part = data[low:low + b - a]
            out.append(part)
            a += len(part)
            k += 1
        return b"".join(out)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2,
                 frame: int = FRAME) -> list[tuple[str, int, int]]:
    """Write all documents and return (file, documents, ids) in the order of the ids: a row per partition.

    Texts are moved once, to ranges of ids; each range is encoded and written as one file.
    """
    def task(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        system, root = _store(folder)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.zst"
        written, end = 0, struct.pack("<I", end_id)
        attempt = f"{root}/_{name}-{uuid.uuid4().hex}"
        writer = sink = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                if writer is None:
                    sink = system.open_output_stream(attempt)
                    writer = FrameWriter(sink, frame)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder(tokenizer).encode(some.column(1).to_pylist())):
                    writer.add(doc_id, ids + end)
                    written += 1
        if writer is not None:
            writer.close()
            sink.close()
            system.move(attempt, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([written]), pa.array([writer.ids])],
                                             names=["part", "file", "documents", "ids"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    made = rows.mapInArrow(task, "part long, file string, documents long, ids long").collect()
    return [(r.file, r.documents, r.ids) for r in sorted(made)]


def read_tokens(spark: SparkSession, folder: str, files: list[tuple[str, int, int]], wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents, or of the wanted ids, from the files."""
    starts = np.concatenate([[0], np.cumsum([f[2] for f in files])]) if files else [0]
    listed = [(name, int(a)) for (name, _, _), a in zip(files, starts)]
    chosen = None if wanted is None else set(wanted)

    def task(batches):
        system, root = _store(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{root}/{name}") as source:
                    reader, rows, size = FrameReader(source), [], 0
                    for k, (doc_id, null) in enumerate(zip(reader.doc_ids.tolist(), reader.nulls.tolist())):
                        if chosen is not None and (null or doc_id not in chosen):
                            continue
                        ids = reader.read(k)
                        rows.append((None if null else doc_id, before + int(reader.starts[k]), len(ids) // 4, zlib.crc32(ids), ids))
                        size += len(ids)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    listing = spark.createDataFrame(listed, "file string, start long").repartition(max(1, len(listed)))
    return listing.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
