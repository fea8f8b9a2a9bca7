"""The queries of the operators in this package, and their SQL."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import (
    byte_bpe, chat, edits, licences, mixing, neighbours, packing, quality, resampling, simhash, token_files, tokens, url_filters, whitening)
from ledgerloom.llm.workers import importable
from ledgerloom.session import adopt, scratch_dir, stage

BLOCK = [("net", "/"), ("example.com", "/de/")]
ALLOW = [("example.net", "/en/"), ("org", "/fr/")]
CONTROL_CONVERSATION = -7
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(adopt(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.classed_fingerprints(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.word_file())


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.createDataFrame([(CONTROL_CONVERSATION, 0, "user", CONTROL_TEXT), (CONTROL_CONVERSATION, 1, "assistant", CONTROL_TEXT)],
                                    "conv_id long, turn long, role string, text string")

    def read_back(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            plain, lists = (c.to_pylist() for c in batch.columns[:2]), map(chat.list_parts, batch.columns[2:])
            for conv, text, starts, ends, inside in zip(*plain, *lists):
                turns, loss = chat.parse(text), chat.loss_text(text, starts, ends, inside)
                said = "".join(f"{role}\n{content}\n" for role, content in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    made = chat.format_conversations(turns.unionByName(control), tokens.byte_file())
    return made.select("conv_id", "formatted", "token_start", "token_end", "loss_mask").mapInArrow(
        read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    out = mixing.mix(stage(docs, "sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    sizes = vectors.where(neighbours.usable("embedding")).groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    dims = sizes.agg(F.max_by("dims", F.struct("n", "dims"))).first()[0]
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), neighbours.Hashing(dims or 1))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark, "tokens")
    files = token_files.write_tokens(docs, folder, tokens.word_file())
    return token_files.read_tokens(spark, folder, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), BLOCK, ALLOW)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = byte_bpe.rank_file(), byte_bpe.rank_pattern()
    docs = byte_bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return byte_bpe.decoded(docs, path, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_edit_fingerprints, op2_best_fit_packing, op3_chat_formatting, op4_source_mixing, op5_nearest_neighbours,
    op6_licence_scan, op7_token_files, op8_url_filter, op9_simhash, op10_quality_classifier, op11_byte_bpe,
    op12_embedding_whitening, op13_importance_resampling)}


_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST) AS k FROM per),
levels AS (
  SELECT a.k, (CAST((SELECT sum(source_size) FROM per) AS DOUBLE) - coalesce((SELECT sum(b.cap) FROM ordered b WHERE b.k < a.k), 0.0::DOUBLE))
           / (SELECT sum(b.w) FROM ordered b WHERE b.k >= a.k) AS level, a.cap / a.w AS ratio FROM ordered a),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels WHERE level <= ratio) * w) AS target FROM ordered),
keyed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(round(t.target) AS BIGINT) AS words, substr(md5(concat_ws(':', '42', CAST(s.doc_id AS VARCHAR), CAST(s.size AS VARCHAR))), 1, 10) AS h
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
run AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM keyed)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, words - whole * source_size - before)) AS BIGINT) AS taken
FROM run
"""


def _licence_sql() -> str:
    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.KNOWN)
    return f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(license) AS license
  FROM (SELECT license, {licences.canonical_sql('text')} AS form FROM (VALUES {known}) AS t(license, text))
  WHERE form <> '' GROUP BY 1),
whole AS (SELECT doc_id, text, {licences.canonical_sql('text')} AS form FROM documents),
lines AS (SELECT doc_id, {licences.canonical_sql('line')} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
notices AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices
  FROM (SELECT DISTINCT l.doc_id, k.license FROM lines l JOIN known k ON sha256(l.form) = k.digest WHERE l.form <> '') GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN w.form <> '' THEN sha256(w.form) END AS digest, k.license, n.notices
FROM whole w LEFT JOIN known k ON sha256(w.form) = k.digest AND w.form <> '' LEFT JOIN notices n ON w.doc_id = n.doc_id
"""


def _url_sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted([(h, p, "block") for h, p in BLOCK] + [(h, p, "allow") for h, p in ALLOW], key=lambda r: -len(r[0] + r[1]))
    which = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {which} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts
"""


ORACLES = {"op4_source_mixing": _MIX_SQL, "op6_licence_scan": _licence_sql(), "op8_url_filter": _url_sql()}
