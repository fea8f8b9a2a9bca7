"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the largest cosine is the smallest Euclidean distance.
A table has ``functions`` hash functions floor((a.x + b) / width) with Gaussian a (Datar and
others, 2004). A query looks into its own bucket of each table and into perturbed ones, in
order of their estimated chance (Lv and others, "Multi-probe LSH", 2007): the sum of squared
distances to the borders crossed. What the buckets of all tables hold is merged and ranked by
the exact cosine of the original vectors, in double precision. A product of matrices finds the
pairs that may count; their scores are sums in a fixed order, which depend on the two vectors only.

Buckets of a table lie close together if they agree in its first functions. Vectors are sent to
such a region once per table, and a query once to each region that holds a bucket it visits,
with the list of these, not once per bucket. How many functions make a region follows the
number of rows; it changes what a task holds, not what is found.

Defined results: vectors that are null, of length 0, or that hold a null or a component that
is not finite take no part. A query finds every row but those of its own id; ties go to the
smaller id. Rows that repeat are candidates once each, so an id may be found twice. Rows with a
null id are not found. An empty table gives an empty result. Vectors whose number of components
is not ``Hashing.dims`` take no part; the query sets that to the most frequent one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ledgerloom.llm.runs import over_runs
from ledgerloom.session import stage

CELL = 4096     # vectors of one region held by one task run; larger regions are split
QUERIES = 4096  # queries of one region met by one task run; the same
SPREAD = 3      # values that most hash values are among, for the size of regions
SCORES = 1 << 20    # scores held at once
PAIRS = 1 << 16     # pairs scored exactly at once
MARGIN = 1e-11      # above the rounding of a product; pairs so close to the k-th are scored in fixed order


@dataclass(frozen=True)
class Hashing:
    """Hash tables for vectors of ``dims`` components."""

    dims: int
    tables: int = 3
    functions: int = 6
    width: float = 1.7
    probes: int = 200
    seed: int = 7

    def draws(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return (rng.normal(size=(self.dims, self.tables * self.functions)),
                rng.random(self.tables * self.functions) * self.width)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Real-valued places, by row, table and function; their floors are the bucket."""
        a, b = self.draws()
        return ((unit @ a + b) / self.width).reshape(len(unit), self.tables, self.functions)

    def leading(self, rows: int) -> int:
        """How many functions make a region, so that one of ``rows`` vectors has about ``CELL``."""
        return min(self.functions, max(1, math.ceil(math.log(max(rows, 1) / CELL, SPREAD))))

    def keys(self, buckets: np.ndarray, functions: int | None = None) -> np.ndarray:
        """64-bit keys of (..., table, function) buckets by their first functions (all by default), different by table."""
        out = np.zeros(buckets.shape[:-1], np.uint64)
        tags = np.arange(self.tables, dtype=np.uint64).reshape((1,) * (buckets.ndim - 2) + (-1,)) if buckets.ndim >= 2 else 0
        out = out + (tags + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)   # far apart, as buckets are small numbers
        for k in range(functions or self.functions):
            out = (out ^ buckets[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def perturbations(self) -> list[tuple[tuple[int, int], ...]]:
        """Sets of (function rank, side) in the order of their expected cost, for template borders.

        Borders of a query, ordered by distance, are expected at z_j^2 (Lv and others); sets are
        listed once by that and applied to every query's own order of borders.
        """
        m = self.functions
        z = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else
             1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
             for j in range(1, 2 * m + 1)]
        from itertools import combinations
        sets = [s for size in range(0, m + 1) for s in combinations(range(2 * m), size)
                if not any(2 * m - 1 - j in s for j in s)]
        return sorted(sets, key=lambda s: (sum(z[j] for j in s), s))[:self.probes]

    def probed(self, places: np.ndarray) -> np.ndarray:
        """(row, probe, table, function) buckets each row visits, its own first."""
        rows, tables, m = places.shape
        low = np.floor(places)
        down = places - low                       # distance to the border below
        borders = np.concatenate([down, 1 - down], axis=2)
        order = np.argsort(borders, axis=2, kind="stable")
        # The rank of a border and of the opposite one add up to 2m - 1.
        out = np.empty((rows, self.probes, tables, m))
        sets = self.perturbations()
        out = np.repeat(low[:, None], len(sets), axis=1)
        r, t = np.ogrid[:rows, :tables]
        for k, some in enumerate(sets):
            for rank in some:
                at = order[:, :, rank]
                out[r, k, t, at % m] += np.where(at < m, -1, 1)
        return out


def usable(vec: str) -> F.Column:
    """Whether a vector takes part."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _dealt(rows: DataFrame, query: bool, cells: F.Column, blocks: F.Column) -> DataFrame:
    """Add ``cell`` and ``block``: vectors go to one cell of every block, queries to one block of every cell."""
    def one(n, salt):
        return F.pmod(F.xxhash64(F.lit(salt), "id"), n).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    if query:
        return rows.withColumn("cell", each(cells.cast("int"))).withColumn("block", one(blocks, 11))
    return rows.withColumn("block", each(blocks.cast("int"))).withColumn("cell", one(cells, 7))


def nearest(df: DataFrame, queries: DataFrame, hashing: Hashing, id_col: str = "vec_id", vec: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found among ``df`` for each row of ``queries``.

    Vectors go to the regions they are in, once per table; queries to those of the buckets they
    visit. A run of equal keys is one region: its queries are compared bucket by bucket, keep
    their ``k`` best of the region, and these are merged. Regions over ``CELL`` vectors or
    ``QUERIES`` queries are split by vector and by query: a run is one cell of vectors and one
    block of queries, and every cell meets every block. A query that finds fewer than ``k`` ids
    so is compared with all rows.
    """
    floats = all(x.schema[vec].dataType.elementType == T.FloatType() for x in (df, queries))
    kind = "array<float>" if floats else "array<double>"    # narrow vectors are moved as they are

    def ready(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast(kind).alias("vec")).where(
            F.col("id").isNotNull() & (F.size("vec") == hashing.dims) & usable("vec"))

    n = ready(df).count()
    leading = hashing.leading(n)

    def hashed(query: bool):
        def task(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                x = flat.reshape(batch.num_rows, -1)
                wide = x.astype(np.float64)
                wide = wide / np.abs(wide).max(axis=1, keepdims=True)
                unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
                for at in range(0, len(x), 256):
                    places = hashing.places(unit[at:at + 256])
                    buckets = hashing.probed(places) if query else np.floor(places)
                    fine = hashing.keys(buckets).reshape(len(places), -1)
                    row = np.repeat(np.arange(at, at + len(places)), fine.shape[1])
                    fine, region = fine.ravel(), hashing.keys(buckets, leading).ravel()
                    order = np.lexsort((region, row))
                    row, region, fine = row[order], region[order], fine[order]
                    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (region[1:] != region[:-1])])
                    index = pa.array(row[starts])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(region[starts]), pa.array(np.full(len(starts), query)), batch.column(0).take(index),
                         batch.column(1).take(index), pa.array([f.tobytes() for f in np.split(fine, starts[1:])], pa.binary())],
                        names=["key", "query", "id", "vec", "buckets"])
        return task

    schema = f"key long, query boolean, id long, vec {kind}, buckets binary"
    index = ready(df).mapInArrow(hashed(False), schema)
    asked = ready(queries).mapInArrow(hashed(True), schema)
    # Split what is over CELL or QUERIES: two aggregates over the keys. They are staged, so that Spark knows
    # their size before it plans the joins and moves the vectors for them only where it must.
    cells, blocks = (stage(rows.groupBy("key").count().where(F.col("count") > most).select(
        "key", F.ceil(F.col("count") / most).cast("int").alias(name)), name.strip("_"))
        for rows, most, name in ((index, CELL, "_cells"), (asked, QUERIES, "_blocks")))

    def dealt(rows: DataFrame, query: bool) -> DataFrame:
        rows = rows.join(cells, "key", "left").join(blocks, "key", "left")
        return _dealt(rows, query, F.coalesce("_cells", F.lit(1)), F.coalesce("_blocks", F.lit(1))).drop("_cells", "_blocks")

    index, asked = dealt(index, False), dealt(asked, True)

    def compared(a, owns, b, mine):
        """The k best of one bucket for each of its queries; ``mine`` ascends."""
        starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        step = max(1, SCORES // len(mine))
        for at in range(0, len(a), step):
            own = owns[at:at + step]
            rough = cosines(a[at:at + step], b)
            rough[own[:, None] == mine] = -np.inf
            ids = rough if len(starts) == len(mine) else np.maximum.reduceat(rough, starts, axis=1)
            least = np.partition(ids, -k, axis=1)[:, -k] - MARGIN if len(starts) > k else np.full(len(own), -np.inf)
            row, col = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
            score = np.concatenate([np.empty(0), *(pair_cosines(a[at + row[i:i + PAIRS]], b[col[i:i + PAIRS]]) for i in range(0, len(row), PAIRS))])
            yield best_of(own[row], mine[col], score, k)

    def places_of(run, some):
        """(bucket, position in the run) of rows, by bucket and id."""
        rows = np.flatnonzero(some)
        bucket = np.frombuffer(b"".join(run["buckets"][rows]), np.int64)
        row = np.repeat(rows, [len(x) // 8 for x in run["buckets"][rows]])
        order = np.lexsort((run["id"][row], bucket))
        return bucket[order], row[order]

    def best(run):
        q = run["query"].astype(bool)
        if q.all() or not q.any():
            return None
        vectors, ids = run["vec"].astype(np.float64), run["id"]
        (visits, visitor), (own, member) = places_of(run, q), places_of(run, ~q)
        out, held = [], 0
        for bucket in np.intersect1d(own, visits):
            who = visitor[np.searchsorted(visits, bucket):np.searchsorted(visits, bucket, side="right")]
            here = member[np.searchsorted(own, bucket):np.searchsorted(own, bucket, side="right")]
            for found in compared(vectors[who], ids[who], vectors[here], ids[here]):
                out.append(found)
                held += len(found[0])
                if held > SCORES:
                    out = [best_of(*(np.concatenate(c) for c in zip(*out)), k)]
                    held = len(out[0][0])
        return list(best_of(*(np.concatenate(c) for c in zip(*out)), k)) if out else None

    def ranked(rows: DataFrame) -> DataFrame:
        found = over_runs(rows, ["key", "cell", "block"], best, "query_id long, id long, score double")
        # An id found in several tables counts once; a group has at most k rows per region visited.
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

    found = stage(ranked(index.unionByName(asked)), "neighbours")
    # Queries whose buckets held fewer than k ids meet all rows, in blocks.
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stage(ready(queries).join(full, "id", "left_anti"), "short")
    m = short.count()
    if not m:
        return found
    rows = [_dealt(x.select(F.lit(0).cast("long").alias("key"), F.lit(q).alias("query"), "id", "vec", F.lit(bytes(8)).alias("buckets")),
                   q, F.lit(-(-n // CELL)), F.lit(-(-m // QUERIES)))
            for x, q in ((ready(df), False), (short, True))]
    exact = ranked(rows[0].unionByName(rows[1]))
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(exact)


def best_of(query: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best score of each item, then the k best items of each query, smaller ones first among equals."""
    sort = np.lexsort((-score, item, query))
    query, item, score = query[sort], item[sort], score[sort]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (item[1:] != item[:-1])
    query, item, score = query[new], item[new], score[new]
    sort = np.lexsort((item, -score, query))
    query, item, score = query[sort], item[sort], score[sort]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], item[keep], score[keep]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of a with all of b; scaled first, so that no square overflows."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def pair_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with the same rows of b, each a sum in order of the components."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        dot += x * y
        na += x * x
        nb += y * y
    return dot / (np.sqrt(na) * np.sqrt(nb))
