"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelane.llm import ann, langid, line_dedup, minhash, packing, quality, quotes, segment, sharding, simhash
from wirelane.llm.common import Scratch, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each vector whose id is divisible by 100."""
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 100 == 0)


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes; `slot` is the place in the shard."""
    placed, _ = sharding.shard_records(documents(spark, sf_dir), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


#: Documents whose fingerprints differ in so many bits at most are near; searched for every document whose id is divisible by NEAR_QUERIES.
NEAR_BITS, NEAR_QUERIES = 3, 20


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_within: of the documents searched for, how many others are within NEAR_BITS bits, found by block tables; null for the rest."""
    scratch = Scratch(spark, "simhash")
    out = scratch.save(simhash.compare_with_edits(documents(spark, sf_dir)), "prints")
    near = simhash.neighbours(out, F.col("doc_id") % NEAR_QUERIES == 0, NEAR_BITS)
    out = out.join(near, ["hi", "lo"], "left")
    fingerprint = simhash.as_text(F.col("hi"), F.col("lo")).alias("fingerprint")
    edited = simhash.as_text(F.col("edited_hi"), F.col("edited_lo")).alias("edited_fingerprint")
    n_within = F.when(F.col("doc_id") % NEAR_QUERIES == 0, F.col("n_within") - 1).alias("n_within")
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint, edited, "near_edited", "near_next", n_within)


def _sampled(rows: DataFrame, keys: list[str]) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return segment.sample_segmentations(rows.select(*keys, "text"), model, keys, digest=True)


@query
def op4_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sampled segmentations of each document."""
    return _sampled(documents(spark, sf_dir), ["doc_id"])


@query
def op4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sampled segmentations of each message of the conversations."""
    return _sampled(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn"])


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.identify(docs, langid.fit(docs)).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", F.size("found.spans").alias("n_spans"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("body_sha256", F.sha2(F.col("body").cast("binary"), 256)).drop("body")


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


ORACLE_SQL["op8_line_dedup"] = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.first_doc < k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
