"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots (thousands). The bytes and rows of each slot are summed
on the executors; slots, not records, are then dealt to shards, so all that is decided centrally has
the size of the slot table whatever the number of records. The slot-to-shard map is a table with
a version; rebalancing or adding a shard edits the map and writes the next version, and every
older one stays readable.

Only built-in functions of Spark take part; the map of at most MAX_SLOTS entries is made by plain
arithmetic on the driver.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelane.llm.common import Scratch, int_array

SLOTS = 4096
#: The bound of what is collected and broadcast: one small row per slot.
MAX_SLOTS = 65536
#: Records of one slot are ranked in parts of about so many.
PART_ROWS = 50_000
#: Counted for each record besides its text.
ROW_BYTES = 8


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: it depends on the key and the number of slots alone. A null key has a slot too."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def deal(weights: dict[int, int], shards: int) -> dict[int, int]:
    """Slots to shards: the heaviest first, each to the shard with the fewest bytes; ties by number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(weights, key=lambda s: (-weights[s], s)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + weights[slot], shard))
        out[slot] = shard
    return out


def rebalance(owner: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """Edit a map for `shards` shards, moving few bytes.

    Slots move only from a shard above the mean to one below it: what a new shard takes, it takes
    into itself, and slots of a shard that no longer exists are dealt out again.
    """
    load = dict.fromkeys(range(shards), 0)
    out = {}
    loose = []
    for slot, shard in owner.items():
        if shard < shards:
            out[slot] = shard
            load[shard] += weights.get(slot, 0)
        else:
            loose.append(slot)
    mean = sum(weights.values()) / shards
    by_shard: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in out.items():
        by_shard[shard].append(slot)
    for shard in range(shards):
        for slot in sorted(by_shard[shard], key=lambda s: (-weights.get(s, 0), s)):
            w = weights.get(slot, 0)
            if w and load[shard] - w >= mean:
                load[shard] -= w
                del out[slot]
                loose.append(slot)
    heap = [(v, s) for s, v in load.items()]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weights.get(s, 0), s)):
        total, shard = heap[0]
        heapq.heapreplace(heap, (total + weights.get(slot, 0), shard))
        out[slot] = shard
    return out


class SlotMap:
    """Versions of the slot-to-shard map, each a table (slot, shard, bytes, rows, first_place) in one folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, slots: int = SLOTS):
        if not 0 < slots <= MAX_SLOTS:
            raise ValueError(f"between 1 and {MAX_SLOTS} slots")
        self.spark, self.scratch, self.slots = spark, scratch, slots
        self.version = 0

    def _write(self, owner: dict[int, int], stats: dict[int, tuple[int, int]]) -> int:
        places: dict[int, int] = {}
        rows = []
        for slot in range(self.slots):
            size, count = stats.get(slot, (0, 0))
            shard = owner[slot]
            rows.append([slot, shard, size, count, places.get(shard, 0)])
            places[shard] = places.get(shard, 0) + count
        self.version += 1
        fields = "array<struct<slot:int,shard:int,bytes:bigint,rows:bigint,first_place:bigint>>"
        text = json.dumps([dict(zip(("slot", "shard", "bytes", "rows", "first_place"), r, strict=True)) for r in rows])
        table = self.spark.range(1).select(F.inline(F.from_json(F.lit(text), fields)))
        table.coalesce(1).write.parquet(self.scratch.path(f"map/version={self.version}"))
        return self.version

    def create(self, stats: dict[int, tuple[int, int]], shards: int) -> int:
        weights = {slot: stats.get(slot, (0, 0))[0] for slot in range(self.slots)}
        return self._write(deal(weights, shards), stats)

    def edit(self, stats: dict[int, tuple[int, int]], shards: int) -> int:
        """The next version, made from the last one for new sizes or another number of shards."""
        owner = {r["slot"]: r["shard"] for r in self.table().select("slot", "shard").collect()}
        return self._write(rebalance(owner, {k: v[0] for k, v in stats.items()}, shards), stats)

    def table(self, version: int | None = None) -> DataFrame:
        fields = "slot int, shard int, bytes bigint, rows bigint, first_place bigint"
        return self.spark.read.schema(fields).parquet(self.scratch.path(f"map/version={version or self.version}"))


def slot_stats(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each virtual slot; at most one row per slot reaches the driver."""
    return {r[0]: (r[1], r[2]) for r in records.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()}


def shard_records(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Deal the rows of docs (doc_id, text) out to shards of nearly equal bytes.

    Returns (doc_id, size, text_crc32, virtual_slot, shard, place) and the map. size is the text's
    UTF-8 bytes plus ROW_BYTES; a null text has no bytes and the checksum of the empty string. place
    counts the rows of a shard from 0 without a gap: slot by slot, part by part, by doc_id and checksum
    within one. A null doc_id has the slot of its text's hash; repeated rows are each dealt, to one slot if
    they share a doc_id. Texts may have any length. Other columns, also ones named like those returned, are not
    carried. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(docs["text"], F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text)), slots).alias("virtual_slot"))
    records = scratch.save(records, "records")  # few bytes a row: the texts are read once
    slot_map = SlotMap(spark, scratch, slots)
    stats = slot_stats(records)
    slot_map.create(stats, shards)
    owner = slot_map.table().select(F.col("slot").alias("virtual_slot"), "shard", "first_place")
    # As many parts as a slot's records need: no task ranks many more than PART_ROWS.
    parts_of = int_array([-(-stats.get(slot, (0, 1))[1] // PART_ROWS) for slot in range(slots)])
    records = records.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id", "text_crc32", "size"), F.element_at(parts_of, F.col("virtual_slot") + 1)).cast("int"))
    key = ["virtual_slot", "part"]
    before = F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = records.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(parts, key)
    # Bounded by MAX_SLOTS rows of 16 bytes.
    placed = ranked.join(F.broadcast(owner), "virtual_slot").withColumn("place", F.col("first_place") + F.col("before") + F.col("rank"))
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "place"), slot_map
