"""Best-fit-decreasing packing of tokenized documents into sequences of bounded length.

What best-fit decreasing does depends on how many pieces have each length alone, and bins with the
same room left are alike. So the packing is planned from a histogram of at most `capacity` lengths:
pieces of one length are placed many at a time into runs of alike bins. A segment tree over
remaining capacities finds the tightest one that fits in logarithmic time. The plan's size depends
on the capacity, not on the number of documents; the executors number the pieces of each length and
look their places up in it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelane.llm.common import Scratch, int_array, shuffle_partitions, slices, tidy, worker_cache

CAPACITY = 4096
END_ID = 1
#: Pieces of one length are numbered in parts of about so many rows at most.
PART_ROWS = 50_000
CACHE_WORDS = 500_000

# The white space of the tokenizer's patterns, which is Unicode's; and the steps before its merges that PARTS is made for.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: Parts that the tokenizer treats apart whatever stands around them: a run of Latin letters before
#: white space, a digit or a symbol; a run of ASCII symbols before white space, a digit or a letter;
#: else all up to the next white space. Apostrophes bind, so they stay with what is around them.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SYMBOL = r"!-&(-/:-@\[-`{-~"
PARTS = re.compile(rf"[{_LETTER}]+(?=[{WHITE}0-9{_SYMBOL}]|\Z)|[{_SYMBOL}]+(?=[{WHITE}0-9{_LETTER}]|\Z)|[^ \t\n\r]+")


class PartIds(dict):
    """A part of a text to the bytes of its token ids."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        known = json.loads(tokenizer.to_str())
        self.modelled = known["normalizer"] == NORMALIZER and known["pre_tokenizer"] == PRE_TOKENIZER

    def learn(self, parts: set[str]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        new = [p for p in parts if p not in self]
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            words = np.array(found.word_ids, np.int64)
            ids = np.array(found.ids, np.uint32)
            ends = (4 * np.searchsorted(words, np.arange(len(some) + 1))).tolist()
            raw = ids.tobytes()
            self.update(zip(some, map(raw.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def parts(self, text: str) -> list[str]:
        if "<|" in text:  # perhaps a special token: only white space parts it
            return text.split(" ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return PARTS.findall(text)
        return PARTS.findall(text.lower())  # as the tokenizer does; beyond Latin-1 rules may differ

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text. What is not remembered is looked up for all texts at once.

        PARTS holds for one way of normalising and splitting; texts for any other tokenizer are encoded whole.
        """
        if not self.modelled:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        parts = [self.parts(t) for t in texts]
        self.learn(set().union(*parts))
        return [b"".join(map(self.__getitem__, p)) for p in parts]


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        key = ("parts", zlib.crc32(tokenizer.value.encode()))
        encode = worker_cache(key, lambda: PartIds(Tokenizer.from_str(tokenizer.value))).encode
        end = np.uint32(end_id).tobytes()
        for batch in tidy(batches, key):
            for part in slices(batch, "text", 500):
                rows: list[tuple] = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut at capacity."""
    tokenizer = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())  # one vocabulary file
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Counts at capacities 0 to n; the least capacity that is at least a need and has any."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.size
        while i:
            self.sums[i] += count
            i >>= 1

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.sums[i]:
            return need
        while i > 1:  # up to the first ancestor with a filled right sibling, then down its left edge
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, rank, n, bin, offset): pieces rank to rank + n - 1 of a length go to bins bin to bin + n - 1, at offset.

    The bins are those of best-fit decreasing over all pieces one by one: as a piece that fits in
    a bin again finds no tighter one, bins are filled with pieces of a length one after the other.
    """
    tree = CapacityTree(capacity)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first bin, bins) by room left
    steps = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            runs[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        need, rank = counts[length], 0
        while need:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                put(room, bins, -(-need // (capacity // length)))
                bins += runs[room][-1][1]
            first, n = runs[room].pop()
            tree.add(room, -n)
            fit = room // length
            items = min(need, n * fit)
            whole, rest = divmod(items, fit)
            for t in range(min(fit, items)):
                here = whole + (t < rest)
                steps.append((length, rank, here, first, capacity - room + t * length))
                rank += here
            used = whole + bool(rest)
            put(room - fit * length, first, whole)
            put(room - rest * length, first + whole, bool(rest))
            put(room, first + used, n - used)
            need -= items
    return steps


def _place(steps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, rank, bins, offset = steps.value
        for batch in tidy(batches):
            length, own = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # of and rank ascend together, so the step is the last one at or before (length, own).
            lo, hi = np.searchsorted(of, length, "left"), np.searchsorted(of, length, "right")
            while (open_ := hi - lo > 1).any():
                mid = (lo + hi) // 2
                right = open_ & (rank[np.minimum(mid, len(rank) - 1)] <= own)
                lo, hi = np.where(right, mid, lo), np.where(open_ & ~right, mid, hi)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins[lo] + own - rank[lo]), pa.array(offset[lo])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Every row of docs (doc_id, text) is packed, repeated rows and rows with a null doc_id too; a
    null or empty text has the end id alone. Documents longer than capacity are cut, others never, however long
    they are. Pieces of one length are alike to the plan: ties go by doc_id, piece and checksum. Other columns,
    also ones named like those returned, are not carried. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    pieces = scratch.save(pieces, "pieces")
    # At most `capacity` rows.
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    steps = sorted(plan(counts, capacity))
    columns = np.array(steps, np.int64).reshape(-1, 5).T
    known = spark.sparkContext.broadcast((columns[0], columns[1], columns[3], columns[4]))
    # As many parts as a length's pieces need, so that no task numbers many more than its share of all, or PART_ROWS.
    share = min(PART_ROWS, max(1, sum(counts.values()) // shuffle_partitions(spark)))
    parts_of = int_array([-(-counts.get(n, 1) // share) for n in range(capacity + 1)])
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(parts_of, F.col("length").cast("int") + 1)).cast("int")
    pieces = pieces.withColumn("part", part)
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(parts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(known), schema)
