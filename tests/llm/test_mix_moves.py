"""What the mix moves of its documents."""

from pyspark.sql import functions as F

from ledgerloom.llm import mixing


def test_whole_documents_move_at_the_edge_only(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 8)
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"),
        F.array_join(F.array_repeat(F.lit("word"), (F.col("id") % 17).cast("int")), " ").alias("text"), F.lit(0).alias("n_chars"))
    sized = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    out = mixing.mix(sized)
    # One exchange of rows, of those at the edge; the others meet the table of sources where they are.
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    taken = out.groupBy("source").agg(F.sum(F.col("whole") * F.col("size") + F.col("extra")).alias("words"), F.first("target").alias("target")).collect()
    assert len(taken) == 4 and all(r["words"] == round(r["target"]) for r in taken)
    partial = out.where("extra > 0 and extra < size").groupBy("source").count().collect()
    assert all(r["count"] == 1 for r in partial)
    words = mixing.mixed_documents(docs).agg(F.sum(mixing.word_count())).first()[0]
    assert words == sum(r["words"] for r in taken)
