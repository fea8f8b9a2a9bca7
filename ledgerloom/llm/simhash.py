"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set if over half of the hashes of the text's word shingles have it.
Fingerprints link if they differ in at most ``distance`` bits. To find all links, the 64 bits
are dealt into m partitions, correlated bits together. If thresholds t_i >= -1 add up to
``distance`` - m + 1, any fingerprint within ``distance`` of a probing one is within t_i of it
in some partition i (Qin and others, "GPH: Similarity search in Hamming space", 2018). Each
probing fingerprint gets its own thresholds: those with the fewest candidates by an estimate
from the histograms of the partitions' leading bits, by dynamic programming. All fingerprints
that meet under a key are verified exactly; linked ones leave it as a star, never as pairs.

Defined results: a null text counts as empty; a text without words has fingerprint 0, linked
like any other; fewer words than a shingle make one shingle. Rows that repeat, ids that repeat
and null ids are all kept; a component is named by its smallest id that is not null, or null.
An empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.graph import components
from ledgerloom.llm.runs import over_runs, split_hot, stars
from ledgerloom.llm.tokens import words_of
from ledgerloom.session import stage

BITS = 64
LEAD = 10           # leading bits of a partition whose histogram the estimates use
PROBE_COST = 2.0    # making and moving one probe row, in verified candidates


def hash_bits(hashes: list[int]) -> int:
    """The majority bits of 64-bit hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        some = np.array(hashes[at:at + 65_536], dtype=np.uint64)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the lower-cased (A to Z) word shingles of a whole text."""
    from xxhash import xxh64_intdigest
    words = words_of(text.translate(_LOWER) if text and not text.isascii() else (text or "").lower())
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    shifted = [words[i:] for i in range(shingle)]
    return hash_bits([xxh64_intdigest(b" ".join(w), seed) for w in zip(*shifted)])


_LOWER = {c: c + 32 for c in range(65, 91)}


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Add the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))
    return df.withColumn(out, compute(F.col(text)))


def to_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# -- partitions and thresholds -------------------------------------------------------------

def co_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have bits i and j; summed in the partitions first."""
    names = [f"c{j}" for j in range(BITS)]

    def partial(batches):
        import pyarrow as pa
        total = np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.T.astype(np.float64) @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), *map(pa.array, total.T)], names=["i", *names])

    rows = fps.select("fp").mapInArrow(partial, "i int, " + ", ".join(f"{n} double" for n in names)) \
        .groupBy("i").agg(*[F.sum(n) for n in names]).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r[0]] = r[1:]
    return out


def bit_groups(co: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Deal the bits into m partitions of nearly equal width, correlated bits together."""
    p = np.diag(co) / max(n, 1)
    spread = np.sqrt(np.clip(np.outer(p * (1 - p), p * (1 - p)), 1e-12, None))
    like = np.abs((co / max(n, 1) - np.outer(p, p)) / spread)
    np.fill_diagonal(like, 0)
    left, groups = list(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        group = [max(left, key=lambda b: (like[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (like[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def balls(width: int, radius: int) -> int:
    out, term = 0, 1
    for k in range(radius + 1):
        out, term = out + term, term * (width - k) // (k + 1)
    return out


def partition_count(n: int, distance: int) -> int:
    """The number of partitions with the least expected work for n even fingerprints; any is exact."""
    def work(m: int) -> float:
        extra, probes, found = distance - m + 1, 0.0, 0.0
        for i in range(m):
            width = BITS // m + (i < BITS % m)
            t = extra // m + (i < extra % m) if extra >= 0 else 0
            probes += balls(width, t)
            found += balls(width, t) * n / 2.0 ** width
        return PROBE_COST * probes + found
    return min(range(2, distance + 2), key=work) if distance else 1


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The partition's bits of each fingerprint as one number, the first bit leading."""
    out = np.zeros(len(fps), dtype=np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((fps >> np.uint64(b)) & np.uint64(1))
    return out


def estimates(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """Expected candidates and probe costs for threshold -1..most and each value of the leading bits."""
    lead = min(LEAD, width)
    rest = width - lead
    at = np.arange(1 << lead)
    apart = np.bitwise_count(at[:, None] ^ at[None, :])
    within = [(apart == d) @ counts for d in range(most + 1)]
    cost = np.zeros((1 << lead, most + 2))
    for t in range(most + 1):
        found = sum(within[d] * balls(rest, t - d) for d in range(t + 1)) / 2.0 ** rest
        cost[:, t + 1] = found + PROBE_COST * balls(width, t)
    return cost


def allocate(costs: list[np.ndarray], total: int) -> np.ndarray:
    """Per row the thresholds (in -1..) that add up to ``total`` at the least cost.

    ``costs[i][r, t + 1]``: cost for row r of threshold t in partition i. A dynamic program over
    the partitions; its state is the sum of t_i + 1 so far.
    """
    n, m = len(costs[0]), len(costs)
    goal = total + m
    best = np.full((n, goal + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, n, goal + 1), dtype=np.int8)
    for i, cost in enumerate(costs):
        new = np.full_like(best, np.inf)
        for s in range(goal + 1):
            for t in range(min(s, cost.shape[1] - 1) + 1):
                value = best[:, s - t] + cost[:, t]
                better = value < new[:, s]
                new[better, s] = value[better]
                took[i, better, s] = t
        best = new
    out = np.zeros((n, m), dtype=np.int8)
    state = np.full(n, goal)
    for i in range(m - 1, -1, -1):
        t = took[i, np.arange(n), state]
        out[:, i] = t - 1
        state = state - t
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """What to flip to reach every other value within the radius."""
    return np.array([sum(1 << b for b in some) for k in range(1, radius + 1) for some in combinations(range(width), k)],
                    dtype=np.uint64)


# -- links ---------------------------------------------------------------------------------

def probe_rows(fps: DataFrame, groups: list[list[int]], costs: list[np.ndarray], distance: int) -> DataFrame:
    """(key, fp): every fingerprint under its own value in each partition, and under its probes."""
    total = distance - len(groups) + 1

    def task(batches):
        import pyarrow as pa
        known = {}
        for b in batches:
            signed = b.column(0).to_numpy()
            if not len(signed):
                continue
            own = signed.view(np.uint64)
            values = [part_values(own, g) for g in groups]
            lead = [v >> np.uint64(max(0, len(g) - LEAD)) for v, g in zip(values, groups)]
            limits = allocate([c[w.astype(np.int64)] for c, w in zip(costs, lead)], total)
            keys, items = [], []
            for i, (value, group) in enumerate(zip(values, groups)):
                tag = np.uint64(i) << np.uint64(40)
                keys.append(value | tag)
                items.append(signed)
                for t in range(1, int(limits[:, i].max()) + 1):
                    flips = known.setdefault((len(group), t), masks(len(group), t))
                    at = np.flatnonzero(limits[:, i] == t)
                    for some in np.array_split(at, max(1, len(at) * len(flips) // 200_000)):
                        keys.append(((value[some, None] ^ flips[None, :]) | tag).ravel())
                        items.append(np.repeat(signed[some], len(flips)))
                        if sum(map(len, keys)) > 400_000:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(items))], names=["key", "fp"])
                            keys, items = [], []
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(items))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(task, "key long, fp long")


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: their components are those of all exact links."""
    n = fps.count()
    co = co_counts(fps)
    groups = bit_groups(co, n, partition_count(n, distance))
    costs = lead_costs(fps, groups, distance)

    def alike(items, i, rest):
        return np.bitwise_count(items[rest] ^ items[i]) <= distance

    def connect(run):
        items = np.unique(run["fp"])
        if len(items) == 1:
            return None
        roots, members = stars(items.view(np.uint64), alike)
        return [roots.view(np.int64), members.view(np.int64)]

    met = split_hot(probe_rows(fps, groups, costs, distance), "fp")
    return over_runs(met, ["key", "_part"], connect, "a long, b long")


def lead_costs(fps: DataFrame, groups: list[list[int]], distance: int) -> list[np.ndarray]:
    """Cost tables from the histograms of the leading bits: at most 1024 counts a partition."""
    def leads(batches):
        import pyarrow as pa
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for i, g in enumerate(groups):
                lead = (part_values(own, g) >> np.uint64(max(0, len(g) - LEAD))).astype(np.int64)
                values, counts = np.unique(lead, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i)), pa.array(values), pa.array(counts)],
                                                 names=["i", "lead", "n"])

    tables = [np.zeros(1 << min(LEAD, len(g))) for g in groups]
    for i, lead, count in fps.select("fp").mapInArrow(leads, "i long, lead long, n long") \
            .groupBy("i", "lead").agg(F.sum("n")).collect():
        tables[i][lead] = count
    return [estimates(t, len(g), distance) for t, g in zip(tables, groups)]


def group_keys(marked: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, root) for the fingerprints of ``marked`` that have links; root is one fingerprint of the component."""
    distinct = stage(marked.select("fp").distinct(), "fps")
    return components(links(distinct, distance)).select(F.col("node").alias("fp"), "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row."""
    marked = stage(with_fingerprints(df.select(id_col, text), text, "fp", shingle).select(id_col, "fp"), "simhash")
    least = marked.groupBy("fp").agg(F.min(id_col).alias("_least"))
    rooted = least.join(group_keys(marked, distance), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    names = stage(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "components")
    return marked.join(names, "fp").select(id_col, to_hex().alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", order: tuple[str, ...] = ("doc_id",), distance: int = 3, shingle: int = 3) -> DataFrame:
    """One whole row of each component: the first in ``order`` (nulls last), then by text."""
    from pyspark.sql import Window
    columns = df.columns
    marked = with_fingerprints(df.select(text), text, "fp", shingle)
    roots = stage(group_keys(stage(marked.select("fp"), "simhash"), distance), "roots")
    rows = with_fingerprints(df.withColumn("_row", F.struct(*columns)), text, "fp", shingle).select("_row", "fp")
    keyed = rows.join(roots, "fp", "left").select("_row", F.coalesce("root", "fp").alias("_root"))
    first = Window.partitionBy("_root").orderBy(*[F.col(f"_row.{c}").asc_nulls_last() for c in order],
                                                F.col(f"_row.{text}").asc_nulls_first())
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in columns])
