"""Line dedup across documents by levelled sorted runs of line hashes.

Each run is a Parquet table of (h1, h2, first_doc): the 128-bit hashes of lines that were new when
the run was written, sorted, and the smallest document holding each. A new batch is reduced to one
row per line hash, merge-anti-joined with the runs, and what is left becomes a run of level 0. When
a level has `fanout` runs they are merged into one of the next level, so a batch meets a number of
runs that grows with the logarithm of the batches.

Only built-in functions of Spark take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelane.llm.common import ASCII_SPACE, Scratch, ascii_lower, int_array

#: Keys shorter than this are never dropped.
MIN_KEY = 10
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, with A-Z lowered."""
    return F.btrim(ascii_lower(line), F.lit(ASCII_SPACE))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def line_hashes(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of each line whose key has at least min_key code points.

    Two hashes with different seeds make 128 bits, so that different lines of a corpus of 10^12
    lines do not meet. text_hash tells rows apart that carry the same doc_id.
    """
    lines = docs.select("doc_id", F.xxhash64(_text(docs)).alias("text_hash"), F.posexplode(F.split(_text(docs), "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_key)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineRuns:
    """The levels. Batches are to come in ascending order of doc_id; then the run that holds a key has its smallest document."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = FANOUT):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.written = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def table(self) -> DataFrame | None:
        """All runs as one table: their keys are disjoint."""
        return reduce(DataFrame.unionByName, self.runs()) if self.levels else None

    def _write(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"run-{level}-{self.written}"
        self.written += 1
        self.levels[level].append((name, self.scratch.save(df.sortWithinPartitions("h1", "h2"), name)))

    def add(self, lines: DataFrame) -> None:
        """Reduce a batch of line_hashes() to its smallest document by key, keep what no run has, and compact."""
        fresh = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = reduce(DataFrame.unionByName, [run for _, run in old]).repartition("h1", "h2")
            self.levels[level] = []
            self._write(merged, level + 1)
            self.scratch.drop(*(name for name, _ in old))
            level += 1


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_key: int = MIN_KEY, fanout: int = FANOUT) -> DataFrame:
    """Drop each line whose key another document with a smaller doc_id holds.

    Returns every row of docs that has a doc_id, with its columns, and n_lines, n_dropped and
    kept_text (text keeps its place; a column of docs with one of the new names is replaced).
    Null or empty text is one empty line, and its kept_text is empty. A document that loses all
    its lines has an empty kept_text. Rows of the same doc_id are one document: they drop nothing
    of each other. Rows without a doc_id are left out. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text").where(F.col("doc_id").isNotNull())
    scratch = Scratch(spark, "line-dedup")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000)).first()[0] if batches > 1 else None
    batch = F.size(F.filter(int_array(sorted(set(cuts or []))), lambda cut: cut < F.col("doc_id")))
    lines = scratch.save(line_hashes(docs, min_key).withColumn("batch", batch), "lines", partition_by="batch")
    runs = LineRuns(spark, scratch, fanout)
    for i in range(len(set(cuts or [])) + 1):
        runs.add(lines.where(F.col("batch") == i))

    known = runs.table()
    later = lines.join(known, ["h1", "h2"]).where(known["first_doc"] < lines["doc_id"])
    drops = later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops"))
    drops = drops.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("drops").alias("__drops"))
    # By the text's hash too, so that rows of one doc_id with different texts each get their own.
    hit = docs.join(drops, (docs["doc_id"] == drops["__doc"]) & (F.xxhash64(_text(docs)) == drops["__hash"]), "left")
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    out = hit.withColumn("__lines", split).withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("__drops"), F.lit(0)).cast("long"))
    whole = F.col("__drops").isNull()
    joined = F.array_join(F.transform(kept, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n")
    return out.withColumn("kept_text", F.when(whole, F.coalesce(F.col("text"), F.lit(""))).otherwise(joined)).select(*docs.columns, "n_lines", "n_dropped", "kept_text")
