"""From documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and read
again as the next one's docs, so a lost executor costs no more than the stage that runs. All stages but the
last return the columns of docs, whatever they are called, with the users' values: line dedup alone changes
`text` and `n_chars`. Texts may have any length; empty tables give empty ones. Rows without a doc_id go in
the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelane.llm import langid, line_dedup, minhash, packing, quality
from wirelane.llm.common import Scratch, bound_batches, documents

#: A text in which no language has this share of the letters is not in any language.
MIN_SHARE = 0.5
#: Near-duplicates share this per cent of their five-word shingles; op10_minhash keeps its own.
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects. The decision is made row by row, so no text is shuffled.

    Rows without a doc_id and null or empty texts go. Rows that share a doc_id are decided each by its text;
    keys that tie are drawn by doc_id. Without labels of both kinds all that have a text stay.
    """
    bound_batches(spark)
    selector = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    _, _, selected = selector.columns(docs)
    return docs.where(selected).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, of whose letters one language has MIN_SHARE.

    Null texts and those without a letter go, and all do if no row has a lang. Repeated rows share their fate.
    """
    bound_batches(spark)
    found = langid.identify(docs, langid.fit(docs))
    return docs.where((found["lang"] != "und") & (found["score"] >= MIN_SHARE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that one with a smaller doc_id holds; one that has no text left goes.

    So null and empty texts and those of white space go. Rows that share a doc_id drop nothing of each other.
    """
    others = F.struct(*(F.col(c) for c in docs.columns if c not in ("text", "n_chars")))
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", others.alias("others")))
    kept = kept.where(F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")) != "")
    made = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*(made.get(c, F.col("others")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates.

    A text without words is a group by itself. Of rows that share a doc_id and a text one stays; rows that share a doc_id
    with other texts stay with it.
    """
    bound_batches(spark)
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT).where("kept").select("doc_id").distinct()
    again = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]  # 128 bits, so that only equal texts are taken for equal
    rows = docs.join(kept, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", again[0].alias("h1"), again[1].alias("h2"))
    return rows.dropDuplicates(["doc_id", "h1", "h2"]).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed document; see packing.pack(). Every row is packed."""
    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: Hashes, learned models and tokenizers are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
