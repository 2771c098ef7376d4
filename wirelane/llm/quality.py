"""Quality selection by importance resampling.

Two generative models of hashed n-grams are counted: one of target texts (labelled good), one of
all texts. A text's log importance weight is the sum over its n-grams of the log ratio of the two.
Resampling without replacement is Gumbel top-k: each weight gets Gumbel noise seeded by the
document's id, and the k largest sums are taken. k is the number of documents whose weight is on the
good side of the threshold that parts good from bad labels best.

Toxic texts have a measure of their own, which the rest of a text does not outvote: the largest log
ratio of any of its n-grams, by the shares of toxic and of good documents that hold it. Those on the
wrong side of the threshold that parts good from toxic labels best have no weight and are never drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelane.llm.common import Scratch, give_back, shuffle_partitions, tidy
from wirelane.llm.shingles import texts

BITS = 18
#: Buckets of byte 4-grams, and one for words that repeat the word before.
BUCKETS = (1 << BITS) + 1
#: About so many labelled documents, drawn by a hash of doc_id, make the target model, and a third as many others the threshold.
FIT_DOCS = 30_000
#: How much a good document on the wrong side of the threshold weighs against a bad one.
KEEP = 3
#: The part of the target model that is the raw model, so that an n-gram unseen in the target costs about 3 nats at most.
BACKGROUND = 0.05
#: So many documents, dealt to toxic and good ones by their numbers, are taken to hold each n-gram besides those that do.
PRIOR_DOCS = 2
SEED = 6
_TIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def buckets(text: bytes) -> np.ndarray:
    """The bucket of each byte 4-gram of the text, and one for each repeated word; a text of fewer bytes is padded."""
    if not text:
        return np.zeros(0, np.int64)
    x = np.frombuffer(text.ljust(4, b"\0"), np.uint8).astype(np.uint32)
    h = x[:-3] * _TIMES[0] ^ x[1:-2] * _TIMES[1] ^ x[2:-1] * _TIMES[2] ^ x[3:] * _TIMES[3]
    h = (h * _TIMES[0]) >> np.uint32(32 - BITS)
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    return np.concatenate([h, np.full(again, BUCKETS - 1, np.uint32)]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(BUCKETS, np.int64)
    for batch in tidy(batches):
        held, size = [], 0
        for text in texts(batch.column("text")):
            held.append(buckets(text))
            size += len(text)
            if size > 1 << 20:
                table += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, size = [], 0
        if held:
            table += np.bincount(np.concatenate(held), minlength=BUCKETS)
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["bucket", "n"])


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """Counts over all texts of docs; each task adds up its own, and at most BUCKETS sums are collected."""
    out = np.zeros(BUCKETS)
    for bucket, n in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(n-gram | target) - log p(n-gram | raw), the target model holding BACKGROUND of the raw one; 0 without a target."""
    p = (raw + 1e-3) / (raw + 1e-3).sum()
    q = target / max(target.sum(), 1)
    return np.log((1 - BACKGROUND) * q / p + BACKGROUND).astype(np.float32) if target.sum() else np.zeros(BUCKETS, np.float32)


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, good): kind 0, n-grams of good texts; 1 and 2, the good and the toxic texts that hold each, and in place BUCKETS all of them."""
    tables = np.zeros((3, BUCKETS + 1), np.int64)
    for batch in tidy(batches):
        for text, good in zip(texts(batch.column("text")), batch.column("good").to_pylist(), strict=True):
            if not text:
                continue
            own, n = np.unique(buckets(text), return_counts=True)
            if good:
                tables[0, own] += n
            kind = 1 if good else 2
            tables[kind, own] += 1
            tables[kind, BUCKETS] += 1
    kind, at = np.nonzero(tables)
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at), pa.array(tables[kind, at])], ["kind", "bucket", "n"])


def labelled_counts(rows: DataFrame) -> np.ndarray:
    """The three tables of _count_labelled over all of rows (text, good)."""
    out = np.zeros((3, BUCKETS + 1))
    for kind, bucket, n in rows.select(F.col("text").cast("string").alias("text"), "good").mapInArrow(_count_labelled, "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n")).collect():
        out[kind, bucket] = n
    return out


def toxic_ratio(good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """log share of toxic documents that hold an n-gram - log share of good ones; 0 without either kind."""
    n_good, n_toxic = good[BUCKETS], toxic[BUCKETS]
    if not n_good or not n_toxic:
        return np.zeros(BUCKETS, np.float32)
    prior = PRIOR_DOCS / (n_good + n_toxic)
    return (np.log(toxic[:BUCKETS] / n_toxic + prior) - np.log(good[:BUCKETS] / n_good + prior)).astype(np.float32)


def measures(docs: DataFrame, ratio: np.ndarray, toxic: np.ndarray) -> Column:
    """(log_weight, toxicity) of docs.text: the log importance weight, and the largest toxic ratio; both null for a null or empty text."""
    sent = docs.sparkSession.sparkContext.broadcast((ratio, toxic))  # twice BUCKETS floats

    def run(column: pa.Array) -> pa.Array:
        weights, worst = sent.value
        weight, toxicity = [], []
        for t in texts(column):
            own = buckets(t) if t else None
            weight.append(None if own is None else float(weights[own].sum(dtype=np.float64)))
            toxicity.append(None if own is None else float(worst[own].max()))
        give_back()
        return pa.StructArray.from_arrays([pa.array(weight, pa.float64()), pa.array(toxicity, pa.float64())], ["log_weight", "toxicity"])

    return F.arrow_udf(run, "log_weight double, toxicity double")(docs["text"].cast("string"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The value with the least errors, as shares of each kind, those of good ones times KEEP; in the middle of the gap below it."""
    if not len(bad) or not len(good):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    right = -KEEP * np.searchsorted(np.sort(good), values, "left") / len(good) + np.searchsorted(np.sort(bad), values, "left") / len(bad)
    best = values[int(right.argmax())]
    below = bad[bad < best]
    return float((best + below.max()) / 2) if len(below) else float(best)


def top_k_cut(scores: DataFrame, k: int, scratch: Scratch) -> tuple[float, int] | None:
    """(key, doc_id) of the k-th row of scores (doc_id, key) by descending key, then ascending doc_id.

    One range exchange of the scores; the rows of one range alone are ranked, by an executor. None if k is 0.
    """
    if k < 1:
        return None
    n = shuffle_partitions(scores.sparkSession)
    ranges = scratch.save(scores.repartitionByRange(n, F.desc("key"), F.asc("doc_id")).withColumn("range", F.spark_partition_id()), "ranges")
    left = k
    for at, rows in sorted((r[0], r[1]) for r in ranges.groupBy("range").agg(F.count(F.lit(1))).collect()):
        if left <= rows:
            place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("key"), F.asc("doc_id")))
            own = ranges.where(F.col("range") == at).select("key", "doc_id", place.alias("place"))
            row = own.where(F.col("place") == left).select("key", "doc_id").first()
            return row[0], row[1]
        left -= rows
    return -np.inf, 2**63 - 1


class Selector:
    """Models, thresholds and cut of one corpus: fitted once, applied to each row by itself."""

    def __init__(self, ratio: np.ndarray, toxic: np.ndarray, floor: float, ceiling: float, k: int, cut: tuple[float, int] | None, scores: DataFrame):
        self.ratio, self.toxic, self.floor, self.ceiling, self.k, self.cut, self.scores = ratio, toxic, floor, ceiling, k, cut, scores

    def columns(self, docs: DataFrame) -> tuple[Column, Column, Column]:
        """log_weight, key and selected for docs. selected is never null: texts without a weight are not selected."""
        found = measures(docs, self.ratio, self.toxic)
        weight = found["log_weight"]
        return weight, *self.decide(weight, found["toxicity"], docs["doc_id"])

    def decide(self, weight: Column, toxicity: Column, doc_id: Column) -> tuple[Column, Column]:
        toxic = toxicity > F.lit(self.ceiling)
        key = F.when(toxic, F.lit(-np.inf)).otherwise(weight + gumbel(doc_id))
        if self.cut is None:
            return key, F.lit(False)
        at, last = (F.lit(x) for x in self.cut)
        return key, F.coalesce(~toxic & ((key > at) | ((key == at) & (doc_id <= last))), F.lit(False)) & doc_id.isNotNull()


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Selector:
    """Count the models, score all of docs (doc_id, text) and find k and its cut.

    labels: (doc_id, quality, toxic). Good are quality 1 that are not toxic, bad are quality 0 or toxic;
    a document with labels of both kinds, or null ones, is neither. Without good or without bad
    labels every text is selected. Rows without a doc_id are never selected.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    poor, toxic = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") != 0, F.lit(False))
    good = F.when(poor | toxic, 0).when(F.col("quality") == 1, 1)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("least"), F.max(good).alias("most"), F.max(poor).alias("poor"), F.max(toxic).alias("toxic"))
    known = known.where("least = most").select("doc_id", F.col("most").alias("good"), "poor", "toxic")
    total = known.count()
    share = min(1.0, 4 * fit_docs / 3 / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.lit("fit"), "doc_id"), F.lit(4_000_000))
    target, clean, tainted = labelled_counts(docs.where(draw < int(3_000_000 * share)).join(known.where("good = 1 or toxic").select("doc_id", "good"), "doc_id"))
    ratio, worst = log_ratio(target[:BUCKETS], ngram_counts(docs)), toxic_ratio(clean, tainted)
    scores = scratch.save(docs.select("doc_id", measures(docs, ratio, worst).alias("m")).select("doc_id", "m.log_weight", "m.toxicity"), "scores")
    checked = scores.where(draw.between(3_000_000, 3_000_000 + int(1_000_000 * share) - 1)).where("log_weight is not null").join(known, "doc_id").select("good", "poor", "toxic", "log_weight", "toxicity").collect()  # about fit_docs / 3 rows
    floor = threshold(np.array([r.log_weight for r in checked if r.good]), np.array([r.log_weight for r in checked if r.poor]))
    ceiling = -threshold(np.array([-r.toxicity for r in checked if r.good]), np.array([-r.toxicity for r in checked if r.toxic]))
    clean_rows = scores.where(F.col("toxicity") <= F.lit(ceiling))
    k = clean_rows.where(F.col("log_weight") >= F.lit(floor)).count()
    keys = clean_rows.select("doc_id", (F.col("log_weight") + gumbel(F.col("doc_id"))).alias("key"))
    return Selector(ratio, worst, floor, ceiling, k, top_k_cut(keys, k, scratch), scores)


def select(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, log_weight, key, selected) of every row of docs that has a doc_id; see fit(). The key of a toxic text is -inf."""
    selector = fit(docs, labels, fit_docs)
    key, selected = selector.decide(F.col("log_weight"), F.col("toxicity"), F.col("doc_id"))
    return selector.scores.select("doc_id", "log_weight", key.alias("key"), selected.alias("selected"))
