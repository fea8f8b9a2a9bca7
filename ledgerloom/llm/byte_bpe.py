"""Byte-level BPE with a rank file: encoding by padded matrices, and decoding.

A text is split by the file's pattern and every match is encoded by itself. A match that is a
token as a whole is that token. The others are put into matrices of token ids, rows of one
matrix being of similar length and padded at the right; beside the ids stand the ranks of all
neighbouring pairs, looked up in a hash table of pairs. In each round every row merges the
leftmost of its pairs of least rank, closes the gap, and looks up the two pairs that changed;
rows without a pair in the table leave the matrix. Merged pairs have their rank as id, so one
round makes every row of the matrix shorter by one.

Matches beyond ``LONG`` bytes have a row of their own, in which one round merges, from the left,
all pairs of least rank up to the first merge that makes a pair of lower rank: that is what
merging them one by one comes to, in fewer rounds.

Each worker remembers the ids of up to ``REMEMBERED`` distinct matches; texts are taken in slices,
cut where a match must begin, so what is held at once is a slice and the ids of a batch.

Defined results: a null text counts as empty, an empty text has no ids. Any text without lone
surrogates decodes to its own UTF-8 bytes. Rows that repeat, null ids and other columns are
kept as they are; a column of the result's name is replaced. An empty table gives an empty
result. A rank file without all 256 single bytes is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LONG = 512                # bytes; longer matches are merged many pairs at a time
CELLS = 1 << 20           # entries of one matrix
REMEMBERED = 400_000      # distinct matches remembered by a worker before it starts anew
KEPT = 64                 # characters; longer matches are not remembered
SLICE = 1 << 19           # characters split at once
NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

_codecs: dict[tuple[str, str], "Codec"] = {}


class PairTable:
    """Open-addressing hash table from pairs of ids to the rank of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(rank) * 3 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys = self._key(left, right)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == _EMPTY]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[placed], rank[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where a pair is unknown or one side is negative."""
        found = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left[todo], right[todo])
        slots = self._slot(keys)
        while len(todo):
            held = self.keys[slots]
            hit = held == keys
            found[todo[hit]] = self.ranks[slots[hit]]
            on = ~hit & (held != _EMPTY)
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & self.mask
        return found


class Codec:
    """Texts to packed unsigned 32-bit little-endian ids and back."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        single = [self.ids.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError(f"{path} lacks single bytes")
        self.single = np.array(single, np.int32)
        pairs = [(self.ids[a], self.ids[b], rank) for token, rank in self.ids.items() for at in range(1, len(token))
                 if (a := token[:at]) in self.ids and (b := token[at:]) in self.ids]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        self.matches = regex.compile(pattern)
        self.border = regex.compile(r"(?<=\S)\s")
        self.known: dict[str, bytes] = {}

    # -- encoding --------------------------------------------------------------------------

    def slices(self, text: str) -> Iterator[str]:
        """The text in parts; white space after another character begins a match, so cuts lie there."""
        at = 0
        while len(text) - at > SLICE:
            border = self.border.search(text, at + SLICE)
            if border is None:
                break
            yield text[at:border.start()]
            at = border.start()
        yield text[at:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, held = [], 0
        for k, text in enumerate(texts):
            for part in self.slices(text or ""):
                waiting.append((k, self.matches.findall(part)))
                held += len(part)
                if held > SLICE:
                    self._flush(waiting, out)
                    waiting, held = [], 0
        self._flush(waiting, out)
        return [b"".join(parts) for parts in out]

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = list(set().union(*(found for _, found in waiting)).difference(self.known))
        packed = dict(zip(fresh, self.encode_matches([m.encode() for m in fresh])))
        ids = self.known
        ids.update(packed)
        for k, found in waiting:
            out[k].append(b"".join(map(ids.__getitem__, found)))
        for match in packed:
            if len(match) > KEPT:
                del ids[match]

    def encode_matches(self, matches: list[bytes]) -> list[bytes]:
        """Packed ids of each match."""
        out: list[bytes] = [b""] * len(matches)
        wide: dict[int, list[int]] = {}
        for k, match in enumerate(matches):
            whole = self.ids.get(match)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(match) > LONG:
                out[k] = self._long(match)
            elif match:
                wide.setdefault(max(4, 1 << (len(match) - 1).bit_length()), []).append(k)
        for width, rows in wide.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                for k, packed in zip(some, self._matrix([matches[k] for k in some])):
                    out[k] = packed
        return out

    def _matrix(self, matches: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, matches), np.int64, len(matches))
        width = int(lengths.max())
        ids = np.full((len(matches), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(matches), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        rows = np.arange(len(matches))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            if not ranks.shape[1]:
                done.append((rows, ids))
                break
            at = ranks.argmin(axis=1)  # the first of equal ones
            least = ranks[np.arange(len(rows)), at]
            live = least != NONE
            if not live.all():
                done.append((rows[~live], ids[~live]))
                rows, ids, ranks, at, least = rows[live], ids[live], ranks[live], at[live], least[live]
            n, width = ids.shape
            if not n:
                break
            here = np.arange(n)
            ids[here, at] = least
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], least[left])
            ranks[right, at[right]] = self.pairs.find(least[right], ids[right, at[right] + 1])
        out: list[bytes] = [b""] * len(matches)
        for found, made in done:
            kept = made >= 0
            packed = made[kept].astype("<u4").tobytes()
            ends = np.cumsum(kept.sum(axis=1)) * 4
            for row, start, end in zip(found.tolist(), [0, *ends.tolist()], ends.tolist()):
                out[row] = packed[start:end]
        return out

    def _long(self, match: bytes) -> bytes:
        ids = self.single[np.frombuffer(match, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # Of overlapping pairs every second one is met.
            begins = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]
            before = np.where(at > 0, ids[at - 1], -1)
            before[1:][np.diff(at) == 2] = least
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), least, np.int32)
            sooner = (self.pairs.find(before, merged) < least) | (self.pairs.find(merged, after) < least)
            if sooner.any():
                at = at[:int(sooner.argmax()) + 1]
            ids[at] = least
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            at = at - np.arange(len(at))
            changed = np.unique(np.concatenate([at[at > 0] - 1, at[at < len(ranks)]]))
            ranks[changed] = self.pairs.find(ids[changed], ids[changed + 1])
        return ids.astype("<u4").tobytes()

    # -- decoding --------------------------------------------------------------------------

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a file; made once per worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def rank_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rank_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of ``text``, packed as unsigned 32-bit little-endian integers."""
    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(codec(path, pattern).encode(texts.tolist()), dtype=object)
    return df.withColumn(out, encode(F.col(text)))


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; ids that the file doesn't have are an error."""
    @F.pandas_udf("binary")
    def decode(packed: pd.Series) -> pd.Series:
        return pd.Series(list(map(codec(path, pattern).decode, packed)), dtype=object)
    return df.withColumn(out, decode(F.col(ids)))
