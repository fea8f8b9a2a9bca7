"""Mix sources to target weights by capped water-filling, on DataFrame functions only.

The mix is as large as all sources together and shared by weight. A source is repeated at most
``epochs`` times: a target above that stops there and its excess goes to the other sources by
weight, until none is above. That fixed point is min(cap, level x weight) with one level for
all; the sources that stop come first by cap / weight, so one pass over the table of sources
finds it. A source takes each document floor(target / size) whole times, and once more those
that come first by a seeded hash, up to the words still missing; the document at the edge
gives only the words that are missing. Documents are summed in buckets of the hash whose
number follows the source's documents, so that no source is summed in one task.

Defined results: a null text has size 0, a null source is a source of its own, last in order.
Rows that repeat are counted and taken like others; the hash breaks ties by id and size, and
rows equal in those are exchangeable. A source of size 0 has target 0. An empty table gives an
empty result. Column names starting with ``_mix`` are the operator's own; others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import stage

WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
PER_BUCKET = 2048


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, weights: tuple[float, ...], epochs: float) -> DataFrame:
    """(source, _mix_docs, source_size, target) of rows with (source, size): one row per source."""
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("_mix_docs"))
    n = len(weights)
    at = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(at, F.lit(n)) + 1).cast("int"))
    per = per.withColumn("_mix_w", weigh).withColumn("_mix_cap", F.col("source_size") * F.lit(float(epochs)))
    # Sources that stop at their cap come first by cap / weight.
    ratio = F.col("_mix_cap") / F.col("_mix_w")
    order = Window.orderBy(ratio, F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    # The level that holds if exactly the sources before this one stop.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0))) \
        / F.sum("_mix_w").over(onward)
    per = per.withColumn("_mix_level", level).withColumn("_mix_ratio", ratio)
    # Levels rise until the first that no later source is under, and fall after it.
    true_level = F.max(F.when(F.col("_mix_level") <= F.col("_mix_ratio"), F.col("_mix_level"))).over(everything)
    per = per.withColumn("_mix_at", true_level)
    return per.select(source, "_mix_docs", "source_size",
                      F.least(F.col("_mix_cap"), F.coalesce(F.col("_mix_at") * F.col("_mix_w"), F.col("_mix_cap"))).alias("target"))


def mix(df: DataFrame, source: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = (5.0, 2.0, 1.0),
        epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """Add source_size, target, whole (copies) and extra (words of a further, partial copy) to rows with a ``size``.

    Columns of these names are replaced. Sources and hash buckets are summed over ids and sizes alone, in the shared folder.
    Whole rows move only if they are in the one bucket of their source where its words run out. The
    table of sources has one row per source and is joined as Spark sees fit by its size.
    """
    df = df.drop("source_size", "target", "whole", "extra")
    narrow = stage(df.select(source, id_col, "size"), "sizes")
    targets = source_targets(narrow.select(source, "size"), source, weights, epochs) \
        .withColumnRenamed(source, "_mix_source")

    def placed(rows: DataFrame, per: DataFrame) -> DataFrame:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("size").cast("string")))
        unit = F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")  # 40 even bits
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        missing = F.round("target").cast("long") - whole * F.col("source_size")
        buckets = F.ceil(F.col("_mix_docs") / F.lit(PER_BUCKET))
        return rows.join(per, rows[source].eqNullSafe(F.col("_mix_source"))).withColumns({
            "whole": whole, "_mix_missing": missing, "_mix_hash": unit,
            "_mix_bucket": F.floor(unit.cast("double") / F.lit(float(1 << 40)) * buckets).cast("long")})

    # Words before each bucket, from one row per bucket.
    sums = placed(narrow, targets).groupBy("_mix_source", "_mix_missing", "_mix_bucket").agg(F.sum("size").alias("_mix_sum"))
    # Prefix sums in two levels: blocks of buckets, then buckets within a block.
    block = F.floor(F.col("_mix_bucket") / F.lit(PER_BUCKET))
    within = Window.partitionBy("_mix_source", "_mix_block").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("_mix_source").orderBy("_mix_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_mix_block", block)
    blocks = sums.groupBy("_mix_source", "_mix_block").agg(F.sum("_mix_sum").alias("_mix_total")) \
        .withColumn("_mix_above", F.coalesce(F.sum("_mix_total").over(above), F.lit(0)))
    sums = sums.withColumn("_mix_within", F.coalesce(F.sum("_mix_sum").over(within), F.lit(0)))
    starts = sums.alias("s").join(blocks.alias("b"), F.expr("s._mix_source <=> b._mix_source AND s._mix_block = b._mix_block")) \
        .select(F.col("s._mix_source").alias("_mix_s"), F.col("_mix_bucket").alias("_mix_b"), "_mix_missing",
                (F.col("_mix_within") + F.col("_mix_above")).alias("_mix_before"))
    # The words still missing run out in the last bucket that begins before that.
    edges = starts.where(F.col("_mix_before") < F.col("_mix_missing")).groupBy("_mix_s").agg(
        F.max(F.struct("_mix_b", "_mix_before")).alias("_mix_edge"))
    # Staged, so that its size is known when the join with the whole rows is planned.
    per = stage(targets.join(edges, F.col("_mix_source").eqNullSafe(F.col("_mix_s")), "left").drop("_mix_s"), "targets")
    rows = placed(df, per)
    # Buckets before the edge are taken once more, later ones are not. Only the rows of the edge itself move.
    edge = F.col("_mix_bucket") == F.col("_mix_edge._mix_b")
    sure = rows.where(~F.coalesce(edge, F.lit(False))).withColumn(
        "extra", F.when(F.col("_mix_bucket") < F.col("_mix_edge._mix_b"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    inside = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_hash", id_col, "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_mix_missing") - F.col("_mix_edge._mix_before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    at_edge = rows.where(edge).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
    columns = [*df.columns, "source_size", "target", "whole", "extra"]
    return sure.select(*columns).unionByName(at_edge.select(*columns))


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", n_chars: str = "n_chars",
                    weights: tuple[float, ...] = (5.0, 2.0, 1.0), epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """The documents of the mix, each whole copy and each partial copy (its first words) a row."""
    columns = df.columns
    kept = df.select(F.struct(*columns).alias("_mix_row"), F.col(source).alias("source"), F.col(id_col).alias("doc_id"),
                     word_count(text).alias("size"))
    out = mix(kept, "source", "doc_id", weights, epochs, seed)
    # A text of no words takes no words: it comes as often as its source repeats, rounded down.
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")),
                      F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_mix_words", F.explode(copies))
    whole = (F.col("_mix_words") < 0) | (F.col("_mix_words") == F.col("size"))
    words = F.regexp_extract_all(F.col(f"_mix_row.`{text}`"), F.lit(SPACED_WORD), F.lit(0))
    cut = F.when(whole, F.col(f"_mix_row.`{text}`")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("_mix_words").cast("int")), ""))
    out = out.withColumn("_mix_text", cut)
    return out.select(*[
        F.col("_mix_text").alias(c) if c == text
        else F.when(whole, F.col(f"_mix_row.`{c}`")).otherwise(F.length("_mix_text")).cast(df.schema[c].dataType).alias(c) if c == n_chars
        else F.col(f"_mix_row.`{c}`").alias(c) for c in columns])
