"""Connected components by alternating large and small stars, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelane.llm.common import Scratch, shuffle_partitions

#: A node with more edges to larger ones than this, and than an even share of a task, is a hub.
HUB = 64


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): each node of an edge (u, v) but the smallest of its component, and that smallest.

    Each round replaces the edges by as many or fewer ones to smaller neighbours; rounds grow with the
    logarithm of the longest path. A round's table is written before the next begins. Edges are kept from
    the larger end to the smaller one, and the larger ones of a hub never meet in a task: hubs are
    fewer than tasks, so what they are replaced by is broadcast. Self-loops and null ends are ignored.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    now = scratch.save(now, f"{name}-0")
    state, k = _state(now), 0
    while state[0]:
        # Large star: a node's larger neighbours go to its least one. Only nodes with a smaller neighbour change.
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        to = least.select(F.col("a").alias("b"), "m")
        most = max(HUB, state[0] // shuffle_partitions(now.sparkSession))
        hubs = now.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("b").join(to, "b", "left")
        hubs = hubs.select("b", F.coalesce("m", "b").alias("hub_to"))  # fewer rows than tasks
        marked = now.join(F.broadcast(hubs), "b", "left")
        of_hubs = marked.where("hub_to is not null").select("a", F.col("hub_to").alias("b"))
        others = marked.where("hub_to is null").join(to, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = scratch.save(of_hubs.unionByName(others).distinct(), f"{name}-large")
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        after = scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-large")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """Count and checksum: equal states are taken for equal edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(3), "a", "b"))).first())
