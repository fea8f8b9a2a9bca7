"""URL filters by Bloom filter cascades.

A cascade stores which of a finite universe of keys are listed, without error (Larisch and
others, "CRLite", 2017): level 0 encodes the listed keys, level 1 the unlisted keys of the
universe that level 0 mistakes for listed, level 2 the listed ones that level 1 mistakes, and
so on until no level is mistaken. A key of the universe is looked up until a level says no.
The universe is all keys of the corpus: every domain suffix of every host that is no longer than
the longest rule's host, with every path prefix of a length that some rule has. One pass over the corpus finds the few keys that level
0 mistakes; all further levels are built from those. URLs are then judged without a join.

A level's size follows from the number of rules and the logarithm of the size of the universe,
not from the corpus, so the cascades can be sent to every task.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and
gets the default. A rule listed twice counts once, one listed to block and to allow blocks. Of
rules of equal length the one with the longer host wins. Rows and ids that repeat and null ids
are kept. An empty table gives an empty result, no rules the default everywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.session import stage

Rule = tuple[str, str]      # (host, path), as in ("example.net", "/en/")


def host_of(url: str | Column) -> Column:
    """Host of a URL, A to Z in lower case; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: str, path: str, lengths: list[int], widest: int) -> list[str]:
    """Keys that a rule fitting the URL could have, the longest first, of equal length the longer host first.

    No rule's host is longer than ``widest``, so longer suffixes need no look: a host of any length has few keys.
    """
    tail = host[max(0, len(host) - widest - 1):]
    hosts = [tail[i + 1:] for i, c in enumerate(tail) if c == "."]
    if len(host) <= widest:
        hosts.append(host)
    paths = [path[:n] for n in lengths if n <= len(path)]
    return sorted({h + "\0" + p for h in hosts for p in paths}, key=lambda k: (-len(k), k.index("\0") * -1, k))


def positions(keys: list[str], level: int, bits: int, hashes: int) -> np.ndarray:
    """(key, hash) bit positions; levels hash differently."""
    from xxhash import xxh3_128_intdigest
    pairs = np.array([divmod(xxh3_128_intdigest(k, seed=level), 1 << 64) for k in keys], np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        return ((pairs[:, :1] + np.arange(hashes, dtype=np.uint64) * (pairs[:, 1:] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


@dataclass
class Bloom:
    level: int
    bits: int
    hashes: int
    data: np.ndarray

    @classmethod
    def of(cls, keys: list[str], level: int, rate: float) -> "Bloom":
        """A filter of few keys with about the given rate of mistakes."""
        bits = max(8, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        hashes = max(1, round(-math.log2(rate)))
        data = np.zeros(-(-bits // 8), np.uint8)
        at = positions(keys, level, bits, hashes).ravel()
        np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(level, bits, hashes, data)

    def has(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = positions(keys, self.level, self.bits, self.hashes)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, keys: list[str]) -> np.ndarray:
        """Whether each key of the universe is listed: it is if an odd level is the first to say no."""
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        left = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            yes = level.has([keys[i] for i in left])
            out[left[~yes]] = k % 2 == 1
            left = left[yes]
            if not len(left):
                break
        return out


def first_level(listed: list[str], universe: float) -> Bloom:
    """Level 0 leaves about as many mistaken keys as listed ones, divided by the root of two."""
    rate = min(0.5, max(1, len(listed)) / (math.sqrt(2) * max(universe, 1)))
    return Bloom.of(listed, 0, rate)


def finish(first: Bloom, listed: list[str], mistaken: list[str]) -> Cascade:
    """The further levels, from the unlisted keys that level 0 takes for listed."""
    levels, inside, outside = [first], mistaken, listed
    while inside:
        level = Bloom.of(inside, len(levels), 0.5)
        levels.append(level)
        inside, outside = [k for k, yes in zip(outside, level.has(outside)) if yes], inside
    return Cascade(levels)


def cascades(urls: DataFrame, listings: list[list[Rule]], lengths: list[int], widest: int) -> list[Cascade]:
    """One cascade per list of rules, exact on all keys of (host, path) rows.

    The universe is counted (approximately, for the sizes only). The keys that level 0 says yes
    to are found in one pass and made distinct, and the listed ones are taken off by a join: tasks hold
    filters, not rules. What is left, the mistaken keys, are expected to be fewer than the
    rules, whatever the size of the corpus.
    """
    listed = [[f"{h}\0{p}" for h, p in sorted(set(rules))] for rules in listings]

    def universe(batches):
        for batch in batches:
            keys = set()
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.update(keys_of(host, path, lengths, widest))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], names=["key"])

    keys = urls.select("host", "path").mapInArrow(universe, "key string")
    size = keys.agg(F.approx_count_distinct("key")).first()[0]
    firsts = [first_level(keys, size) for keys in listed]

    def passed(batches):
        for batch in batches:
            some = batch.column(0).to_pylist()
            for k, first in enumerate(firsts):
                yes = [x for x, passes in zip(some, first.has(some)) if passes]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(yes), pa.int32()), pa.array(yes, pa.string())], names=["k", "key"])

    own = pa.table({"k": pa.array(np.repeat(np.arange(len(listed), dtype=np.int32), [len(x) for x in listed])),
                    "key": pa.array([key for x in listed for key in x], pa.string())})
    found = keys.mapInArrow(passed, "k int, key string").distinct().join(urls.sparkSession.createDataFrame(own), ["k", "key"], "left_anti").collect()
    return [finish(first, own, sorted(r[1] for r in found if r[0] == k)) for k, (first, own) in enumerate(zip(firsts, listed))]


def judge(pages: DataFrame, block: list[Rule], allow: list[Rule], id_col: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row; the longest rule that fits decides."""
    allow = sorted(set(allow) - set(block))
    urls = stage(pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path")), "urls")
    lengths = sorted({len(p) for _, p in [*block, *allow]})
    widest = max((len(h) for h, _ in [*block, *allow]), default=0)
    blocking, allowing = cascades(urls.select("host", "path"), [list(block), allow], lengths, widest)
    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def task(batches):
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own = [keys_of(h, p, lengths, widest) for h, p in zip(hosts, paths)]
            keys = sorted({k for some in own for k in some})
            decided = {k: "block" for k, yes in zip(keys, blocking.has(keys)) if yes}
            decided.update((k, "allow") for k, yes in zip(keys, allowing.has(keys)) if yes)
            winners = [next((k for k in some if k in decided), None) for some in own]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2),
                pa.array([None if w is None else w.replace("\0", "") for w in winners], pa.string()),
                pa.array([default if w is None else decided[w] for w in winners], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"])

    return urls.mapInArrow(task, schema)
