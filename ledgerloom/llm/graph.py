"""Connected components of a link table, by star contraction.

Alternates large and small stars (Kiveris and others, "Connected components in MapReduce and
beyond", 2014): every node's larger, then smaller neighbours move to its smallest neighbour,
until nothing changes, after O(log^2 n) rounds at most. Each half round is one pre-aggregated
minimum and one join whose large partitions Spark may split; its rows are written to the
shared folder, so a lost executor costs no more than its tasks of the current half round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round over (a, b) rows."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "least")
    moved = near.join(least, "a")
    out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")) if large \
        else moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b")))
    return stage(out.where("a <> b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component."""
    links = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "links")
    before = None
    while True:
        links = _star(_star(links, True), False)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
