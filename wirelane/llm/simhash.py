"""SimHash fingerprints of whole texts, and searches among them within a Hamming radius.

A text's terms are its pairs of neighbouring words; a term weighs as often as it occurs. Each bit of
its 128-bit hash votes for or against the fingerprint's bit. The votes are counted as sums of
32-bit lanes, two to a long, so a text may have up to 2^32 terms. Only built-in functions of Spark
take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelane.llm.common import int_array, shuffle_partitions

BITS = 128
#: For each of the shuffle's partitions, so many runs of neighbouring documents; at most MAX_RUNS.
RUNS_A_PARTITION = 4
MAX_RUNS = 65535
_LANES = 0x0000000100000001
_TOP = 2**63 - 1


def terms(text: Column) -> Column:
    """A 64-bit hash of each word and its successor; the last word's successor is null."""
    words = F.split(F.lower(text), r"\s+")
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _lane_sums(prefix: str, value: Column) -> list[Column]:
    """Bits k and k + 32 of value are counted in the two halves of sum k."""
    return [F.sum(F.shiftrightunsigned(value, k).bitwiseAND(F.lit(_LANES))).alias(f"{prefix}{k}") for k in range(32)]


def _majority(prefix: str) -> Column:
    def bit(k: int) -> Column:
        lane = F.col(f"{prefix}{k % 32}")
        ones = F.shiftrightunsigned(lane, 32) if k >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(ones * 2 > F.col("votes"), F.lit(1 << k if k < 63 else -(2**63))).otherwise(F.lit(0)).cast("long")

    # As a sum of two halves, so that no expression nests 64 deep.
    half = lambda at: reduce(lambda a, b: a.bitwiseOR(b), (bit(k) for k in range(at, at + 32)))
    return half(0).bitwiseOR(half(32))


def fingerprints(rows: DataFrame, key: list[str], terms_column: str) -> DataFrame:
    """(key..., hi, lo): the fingerprint of each key's terms, an array of 64-bit hashes; without terms there is no row."""
    each = rows.select(*key, F.explode(terms_column).alias("term")).withColumn("other", F.xxhash64("term"))
    votes = each.groupBy(*key).agg(F.count(F.lit(1)).alias("votes"), *_lane_sums("a", F.col("term")), *_lane_sums("b", F.col("other")))
    return votes.select(*key, _majority("a").alias("hi"), _majority("b").alias("lo"))


def as_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """The share of equal bits."""
    far = F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))
    return (F.lit(1.0) - far / F.lit(float(BITS))).cast("double")


def _run_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are below doc_id, by binary search."""
    size = 1 << len(cuts).bit_length()
    table = int_array(sorted(cuts) + [_TOP] * (size - len(cuts)))
    halves = int_array([1 << k for k in reversed(range(size.bit_length() - 1))], "int")
    return F.aggregate(halves, F.lit(0), lambda lo, half: F.when(F.element_at(table, lo + half) < doc_id, lo + half).otherwise(lo))


def with_next(docs: DataFrame) -> DataFrame:
    """(run, place, ghost, doc_id, text, next_text) of each document and its successor by doc_id.

    Documents are dealt into runs of neighbouring ids by their quantiles; the first document of
    a run is also sent, as a ghost, to the end of the run before, and the first of all to the last
    run. So each text is shuffled once, and no task holds more than a run.
    """
    n = min(MAX_RUNS, RUNS_A_PARTITION * shuffle_partitions(docs.sparkSession))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    run = _run_of(F.col("doc_id"), sorted(set(found or [])))
    # At most one row per run.
    firsts = sorted((r[0], r[1]) for r in docs.select("doc_id").groupBy(run.alias("run")).agg(F.min("doc_id")).collect())
    before = {r: firsts[i - 1][0] for i, (r, _) in enumerate(firsts)}
    last = firsts[-1][0] if firsts else 0
    first = dict(firsts)
    rows = docs.withColumn("run", run)
    at = F.col("run") + 1
    is_first = F.element_at(int_array([first.get(r, _TOP) for r in range(last + 1)]), at) == F.col("doc_id")
    ghost_run = F.element_at(int_array([before.get(r, 0) for r in range(last + 1)], "int"), at)
    real = F.struct(F.col("run").alias("run"), F.lit(0).alias("ghost"))
    sent = F.when(is_first, F.array(real, F.struct(ghost_run.alias("run"), F.lit(1).alias("ghost")))).otherwise(F.array(real))
    rows = rows.withColumn("sent", F.explode(sent)).select("sent.run", "sent.ghost", "doc_id", "text")
    order = Window.partitionBy("run").orderBy("ghost", "doc_id", F.xxhash64("text"), "text")
    return rows.select("run", F.row_number().over(order).alias("place"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is from the next document.

    docs: (doc_id, text). Returns doc_id, n_chars, edited_sha256, hi, lo, edited_hi, edited_lo,
    near_edited and near_next for each row that has a doc_id. The last floor(n_chars / 2) code
    points are replaced by the first as many of the text that follows by doc_id (all, if it has
    fewer); the first text follows the last, and a lone one itself. A null text is an empty one,
    whose one term is the empty word. Of rows with one doc_id, that with the smaller hash comes first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.when(F.col("ghost") == 0, F.sha2(F.col("edited").cast("binary"), 256)))
    whole = F.struct(F.lit(0).alias("which"), F.col("text").alias("of"), F.lit(None).cast("string").alias("sha"))
    changed = F.struct(F.lit(1).alias("which"), F.col("edited").alias("of"), F.col("edited_sha256").alias("sha"))
    both = rows.select("run", "place", "ghost", "doc_id", "n_chars", F.explode(F.when(F.col("ghost") == 0, F.array(whole, changed)).otherwise(F.array(whole))).alias("t"))
    key = ["run", "place", "ghost", "doc_id", "n_chars", "which", "sha"]
    prints = fingerprints(both.select(*key[:5], "t.which", "t.sha", terms(F.col("t.of")).alias("terms")), key, "terms")
    pick = lambda c, w: F.max(F.when(F.col("which") == w, F.col(c)))
    each = prints.repartition("run").groupBy("run", "place", "ghost", "doc_id", "n_chars").agg(F.max("sha").alias("edited_sha256"), pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("edited_hi"), pick("lo", 1).alias("edited_lo"))
    order = Window.partitionBy("run").orderBy("place")
    out = each.withColumn("next_hi", F.lead("hi").over(order)).withColumn("next_lo", F.lead("lo").over(order)).where("ghost = 0")
    near = likeness(F.col("hi"), F.col("lo"), F.col("edited_hi"), F.col("edited_lo"))
    near_next = likeness(F.col("hi"), F.col("lo"), F.col("next_hi"), F.col("next_lo"))
    return out.select("doc_id", "n_chars", "edited_sha256", "hi", "lo", "edited_hi", "edited_lo", near.alias("near_edited"), near_next.alias("near_next"))


def _block(first: int, end: int) -> Column:
    """The bits first to end of a fingerprint, counted from its most significant one, as a number."""
    hi, lo = F.col("hi"), F.col("lo")
    if end <= 64:
        return F.shiftrightunsigned(hi, 64 - end).bitwiseAND(F.lit((1 << end - first) - 1))
    if first >= 64:
        return F.shiftrightunsigned(lo, 128 - end).bitwiseAND(F.lit((1 << end - first) - 1))
    high = hi.bitwiseAND(F.lit((1 << 64 - first) - 1))
    return F.shiftleft(high, end - 64).bitwiseOR(F.shiftrightunsigned(lo, 128 - end))


def block_tables(prints: DataFrame, radius: int) -> DataFrame:
    """Each distinct fingerprint (hi, lo) once for each of the tables, under the bits that lead there.

    Table t holds the fingerprints permuted so that block t stands first. Of two within the radius at
    least one of radius + 1 blocks is equal, so they meet in the table that it leads.
    """
    blocks = max(radius + 1, 3)  # of 43 bits at most, so that each is a number
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = F.array(*(_block(a, b) for a, b in zip(edges, edges[1:], strict=False)))
    return prints.select("hi", "lo").distinct().withColumn("blocks", parts).select("hi", "lo", "blocks", F.posexplode("blocks").alias("table", "lead"))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """(q_hi, q_lo, hi, lo, distance): all distinct fingerprints within radius of each distinct query, itself included.

    Fingerprints that many rows share are compared once. A pair is found in the first table where
    its blocks agree and in no other, so nothing is counted twice. Null fingerprints take no part.
    """
    known = ["hi", "lo"]
    left = block_tables(queries.dropna(subset=known), radius).select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.col("blocks").alias("q_blocks"), "table", "lead")
    pairs = left.join(block_tables(prints.dropna(subset=known), radius), ["table", "lead"])
    distance = F.bit_count(F.col("hi").bitwiseXOR(F.col("q_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("q_lo")))
    agree = F.arrays_zip("blocks", "q_blocks")
    first = F.size(F.filter(F.slice(agree, F.lit(1), F.col("table")), lambda x: x["blocks"] == x["q_blocks"])) == 0
    return pairs.where(first).withColumn("distance", distance).where(F.col("distance") <= radius).select("q_hi", "q_lo", "hi", "lo", "distance")


def neighbours(prints: DataFrame, is_query: Column, radius: int) -> DataFrame:
    """(hi, lo, n_within): for the fingerprint of each row of prints (doc_id, hi, lo) that is a query, how many rows have one within radius, itself included.

    Equal fingerprints are one class with a count, so copies meet nowhere.
    """
    classes = prints.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    found = within_radius(prints.where(is_query), classes, radius).join(classes, ["hi", "lo"])
    return found.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("n_within"))
