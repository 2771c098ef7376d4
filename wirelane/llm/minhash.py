"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature has SYMBOLS places of 8 bits, the low bits of MinHashes of its word shingles.
Two documents of Jaccard similarity 0.8 differ in 18 of 90 places on average, and in more than RADIUS
once in 100,000 pairs; at 0.85 that is once in 140 million. The signature is split into CHUNKS chunks; by the pigeonhole
principle a pair within RADIUS has a chunk with at most RADIUS // CHUNKS errors. Each allowed error
is enumerated by leaving its place out of the chunk: two chunks with one error are equal where that
place is left out. So all pairs within RADIUS meet under a key, whatever the data.

Exact copies of a shingle set are one class, represented by its smallest doc_id. Where classes meet,
no list of pairs is made: a search from class to class joins those within RADIUS into clusters, and
a second search inside each cluster compares full shingle sets. Both emit a star for each component
found, so what is written is in proportion to the classes.

Crowded keys and clusters are cut into blocks of bounded size. First each member is compared with a few
drawn ones, the pivots, of the most crowded group that it is in, each block by itself. Members of one component of
these links need not be compared with each other any more, under any key: of each group only the strays outside its
largest component are compared, with each other and, once for all its keys, with that whole component, block by block.
Of near copies of one template little is left over, so the work stays in proportion to the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelane.llm.common import Scratch, slices, tidy
from wirelane.llm.graph import components
from wirelane.llm.shingles import U64, WordHashes, sets

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
SYMBOLS, CHUNKS, RADIUS = 90, 18, 35
#: Members of a block; groups of more are compared block by block.
KEY_BLOCK, SET_BLOCK = 512, 128
#: Shingles of a block of full sets.
SET_BLOCK_SHINGLES = 500_000
#: Members of a crowded group that all others are compared with first.
PIVOTS = 4
#: Signatures whose keys one task makes and counts in memory; each has SYMBOLS keys.
KEY_TASK = 10_000

_RNG = np.random.default_rng(10)
_FLIP = _RNG.integers(0, 2**63, size=SYMBOLS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 2**63, size=SYMBOLS, dtype=np.uint64) | U64(1)
#: A random number for each place and symbol: a key is their sum over the places that stay.
_SYMBOL = _RNG.integers(0, 2**63, size=(SYMBOLS, 256), dtype=np.uint64)
_MASK = _RNG.integers(0, 2**63, size=SYMBOLS, dtype=np.uint64)


def signatures(hashes: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS bytes for each set; none may be empty."""
    if not hashes:
        return np.zeros((0, SYMBOLS), np.uint8)
    flat = np.concatenate(hashes)
    starts = np.cumsum([0, *map(len, hashes[:-1])])
    out = np.empty((len(hashes), SYMBOLS), np.uint8)
    for k in range(SYMBOLS):
        # The least product has few high bits set; its bits 24 to 31 are the symbol.
        out[:, k] = (np.minimum.reduceat((flat ^ _FLIP[k]) * _TIMES[k], starts) >> U64(24)).astype(np.uint8)
    return out


def error_keys(signature: np.ndarray) -> np.ndarray:
    """SYMBOLS keys for each signature: for each place, its chunk without that place."""
    n, size = len(signature), SYMBOLS // CHUNKS
    each = _SYMBOL[np.arange(SYMBOLS), signature]
    chunk = each.reshape(n, CHUNKS, size).sum(axis=2, dtype=U64)
    return np.repeat(chunk, size, axis=1) - each + _MASK


def _sketch(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in tidy(batches):
            for part in slices(batch, "text", 256):
                found = sets(part.column("text"), width, cache)
                full = [s for s in found if len(s)]
                signed = iter(signatures(full))
                rows = [(xxhash.xxh128_digest(s.tobytes()), next(signed).tobytes()) if len(s) else (None, None) for s in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tidy(batches):
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            keys = error_keys(rows).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("rep").to_numpy(zero_copy_only=False), SYMBOLS)), pa.array(keys)], ["rep", "key"])


def star_edges(nodes: np.ndarray, side: np.ndarray | None, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Components of a group as stars (node, smallest node), by breadth-first search.

    near(i, others) tells which of the others are linked with member i. A member is compared with
    those not reached yet alone. With sides, only members of different sides are compared.
    """
    left = np.arange(len(nodes))
    out = []
    while len(left):
        queue, left = [left[0]], left[1:]
        reached = [queue[0]]
        while queue and len(left):
            i = queue.pop()
            others = left if side is None else left[side[left] != side[i]]
            if not len(others):
                continue
            hit = others[near(i, others)]
            if len(hit):
                reached.extend(hit)
                queue.extend(hit)
                left = left[~np.isin(left, hit, assume_unique=True)]
        if len(reached) > 1:
            ids = nodes[reached]
            least = ids.min()
            out.extend((int(x), int(least)) for x in ids if x != least)
    return out


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in `by`, from batches sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in tidy(batches):
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = [table.column(c).to_numpy() for c in by]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        starts = [0, *cut.tolist(), table.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def _edges(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in held], pa.int64()), pa.array([e[1] for e in held], pa.int64())], ["u", "v"])

    for edges in found:
        held.extend(edges)
        if len(held) >= 10_000:
            yield batch()
            held = []
    if held:
        yield batch()


#: Given a group, a function (i, others) that tells which of the others are linked with member i.
Near = Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]


def _near_signatures(radius: int, percent: int) -> Near:
    def of(group: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
        size = group.column("n_shingles").to_numpy()

        def near(i: int, others: np.ndarray) -> np.ndarray:
            # The smaller of two linked sets has PERCENT per cent of the larger one's size.
            fits = 100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others])
            return fits & ((signature[others] != signature[i]).sum(axis=1) <= radius)

        return near

    return of


def _near_sets(width: int, percent: int) -> Near:
    held: list[WordHashes] = []

    def of(group: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        if not held:
            held.append(WordHashes())
        found = sets(group.column("text"), width, held[0])
        size = np.array([len(s) for s in found], np.int64)
        ends = np.cumsum(size)
        ids = np.unique(np.concatenate(found), return_inverse=True)[1].astype(np.int32)
        parts = [ids[e - n : e] for e, n in zip(ends, size, strict=True)]
        marked = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
        last: dict = {}

        def near(i: int, others: np.ndarray) -> np.ndarray:
            fits = 100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others])
            out = np.zeros(len(others), bool)
            at = np.flatnonzero(fits)
            if not len(at):
                return out
            some = others[at]
            key = some.tobytes()
            if last.get("key") != key:  # the same others again and again: members that link with nothing
                last.update(key=key, flat=np.concatenate([parts[x] for x in some]), starts=np.cumsum([0, *size[some[:-1]]]))
            marked[parts[i]] = 1
            both = np.add.reduceat(marked[last["flat"]], last["starts"])
            marked[parts[i]] = 0
            out[at] = 100 * both >= percent * (size[i] + size[some] - both)
            return out

        return near

    return of


def _stars(make: Near, group: str) -> Callable:
    def one(table: pa.Table) -> list[tuple[int, int]]:
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        side = table.column("block").to_numpy() if cross else None
        if cross and (side == side[0]).all():
            return []
        return star_edges(table.column("rep").to_numpy(), side, make(table))

    return lambda batches: _edges(one(g) for g in _groups(batches, [group, "i", "j"]) if g.num_rows > 1)


def _with_pivots(make: Near, group: str) -> Callable:
    """An edge to the pivot for each member of a block that is linked with one; the pivots stand first."""

    def one(table: pa.Table) -> list[tuple[int, int]]:
        reps, first = table.column("rep").to_numpy(), int(table.column("pivot").to_numpy().sum())
        members = np.arange(first, table.num_rows)
        if not len(members):
            return []
        near = make(table)
        return [(int(u), int(reps[p])) for p in range(first) for u in reps[members[near(p, members)]] if u != reps[p]]

    return lambda batches: _edges(one(table) for table in _groups(batches, [group, "block"]))


def _links(members: DataFrame, stats: DataFrame, group: str, attach: Callable[[DataFrame], DataFrame], make: Near, rows: int, shingles: int, scratch: Scratch, name: str) -> DataFrame:
    """Edges (u, v) that join the members (group, rep, blocks) of each group of stats (group, n, total, blocks) into its components.

    attach() brings what make() compares to rows that have `rep`. A block has about `rows` members and `shingles` shingles at most.
    A member of several crowded groups meets the pivots of the most crowded one alone; what that joins is known to be joined in all its groups.
    """
    at = lambda n: F.pmod(F.xxhash64("rep", F.lit(1)), n).cast("int")
    zero = F.lit(0).cast("int")
    dealt = members.where("blocks = 1").select(group, zero.alias("i"), zero.alias("j"), zero.alias("block"), "rep")
    crowded, known = stats.where("blocks > 1"), None
    if not crowded.isEmpty():
        own = members.where("blocks > 1")
        inside = own.groupBy("rep").agg(F.max(F.struct("blocks", group)).alias("most")).select("most.*", "rep")
        inside = inside.select(group, at(F.col("blocks")).alias("block"), "rep", F.lit(0).alias("pivot"))
        drawn = [F.min_by("rep", F.xxhash64("rep", F.lit(k))) for k in range(PIVOTS)]
        pivots = own.groupBy(group, "blocks").agg(F.array_distinct(F.array(*drawn)).alias("drawn")).select(group, "blocks", F.explode("drawn").alias("rep"))
        pivots = pivots.select(group, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", F.lit(1).alias("pivot"))
        first = attach(inside.unionByName(pivots)).repartition(group, "block").sortWithinPartitions(group, "block", F.desc("pivot"))
        known = components(first.mapInArrow(_with_pivots(make, group), "u long, v long"), scratch, f"{name}-known")
        own = own.join(known.withColumnRenamed("node", "rep"), "rep", "left").select(group, "rep", F.coalesce("component", "rep").alias("component"))
        own = scratch.save(own, f"{name}-own")
        # Strays are outside the component of most members of their group. They meet each other group by group.
        best = own.groupBy(group, "component").agg(F.count(F.lit(1)).alias("hits")).groupBy(group).agg(F.max(F.struct("hits", "component")).alias("best"))
        left = F.col("n") - F.col("best.hits")
        lefts = F.least(left, F.greatest(F.ceil(left / rows), F.ceil(F.col("total") / shingles))).cast("int")
        best = scratch.save(crowded.join(best, group).where(left > 0).select(group, F.col("best.component").alias("main"), lefts.alias("lefts"), "blocks"), f"{name}-best").alias("b")
        strays = own.alias("o").join(best, (F.col(f"o.{group}") == F.col(f"b.{group}")) & (F.col("o.component") != F.col("b.main")))
        strays = scratch.save(strays.select(f"o.{group}", "o.rep", "b.main", "b.lefts", "b.blocks"), f"{name}-strays")
        numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        among = strays.select(group, "rep", at(F.col("lefts")).alias("block"), numbers(F.col("lefts")).alias("other"))
        # A stray meets that component as a whole once, under however many keys it does: its blocks come first, and mains do not meet each other.
        once = strays.groupBy("main", "rep").agg(F.max("lefts").alias("lefts"), F.max("blocks").alias("blocks"))
        sizes = known.groupBy(F.col("component").alias("main")).agg(F.count(F.lit(1)).alias("others"))
        plan = once.groupBy("main").agg(F.least(F.count(F.lit(1)), F.greatest(F.max("lefts"), F.ceil(F.count(F.lit(1)) / rows))).cast("int").alias("lefts"), F.max("blocks").alias("blocks")).join(sizes, "main", "left")
        mains = F.greatest("blocks", F.ceil((F.coalesce("others", F.lit(0)) + 1) / rows)).cast("int")
        plan = scratch.save(plan.select("main", "lefts", mains.alias("mains")), f"{name}-plan")
        whole = known.select(F.col("component").alias("main"), F.col("node").alias("rep")).unionByName(plan.select("main", F.col("main").alias("rep")))
        number = F.xxhash64("main", F.lit(name)).alias(group)
        few = once.select("main", "rep").join(plan, "main").select(number, "rep", at(F.col("lefts")).alias("block"), "lefts", numbers(F.col("mains")).alias("other"))
        many = whole.join(plan, "main").select(number, "rep", (F.col("lefts") + at(F.col("mains"))).alias("block"), numbers(F.col("lefts")).alias("other"))
        for some in (among, few.withColumn("other", F.col("lefts") + F.col("other")).drop("lefts"), many):
            dealt = dealt.unionByName(some.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep"))
    dealt = attach(dealt).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")
    edges = dealt.mapInArrow(_stars(make, group), "u long, v long")
    return edges if known is None else edges.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text) that has a doc_id.

    Documents are linked where 100 * intersection >= percent * union of their sets of `width`-word
    shingles; a component is what links reach, and component_id its smallest doc_id. A text of
    fewer words is one shingle; a null or empty text, or one of white space, has none and is linked
    with nothing. Equal sets are always linked. Rows that share a doc_id share its component. Other
    columns are not carried; an empty table gives an empty one.
    """
    if radius >= 2 * CHUNKS:
        raise ValueError(f"one error a chunk finds pairs within a radius of {2 * CHUNKS - 1}")
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketch = scratch.save(docs.mapInArrow(_sketch(width), "doc_id long, n_shingles long, set_key binary, signature binary"), "sketch")
    classes = scratch.save(sketch.where("set_key is not null").groupBy("set_key", "signature", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")

    # Keys that classes share. Of keys with the same members, one is enough.
    tasks = -(-classes.count() // KEY_TASK) or 1
    keys = classes.select("rep", "signature").repartition(tasks).mapInArrow(_keys, "rep long, key long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.min("rep").alias("least")).where("n > 1")
    once = shared.groupBy("n", "who", "least").agg(F.min("key").alias("key"))
    once = scratch.save(once.select("key", "n", F.lit(0).alias("total"), F.ceil(F.col("n") / KEY_BLOCK).cast("int").alias("blocks")), "keys")
    members = scratch.save(keys.join(once.select("key", "blocks"), "key"), "members")
    signed = classes.select("rep", "signature", "n_shingles")
    near = _links(members, once, "key", lambda rows: rows.join(signed, "rep"), _near_signatures(radius, percent), KEY_BLOCK, 1 << 62, scratch, "near")
    clusters = components(near, scratch, "clusters")

    # Full sets inside the clusters.
    inside = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).unionByName(clusters.select(F.col("component").alias("rep"), F.col("component").alias("cluster")).distinct())
    inside = scratch.save(inside.join(classes.select("rep", "n_shingles"), "rep"), "inside")
    blocks = F.greatest(F.ceil(F.col("n") / SET_BLOCK), F.ceil(F.col("total") / SET_BLOCK_SHINGLES)).cast("int")
    stats = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    stats = scratch.save(stats.withColumn("blocks", blocks), "stats")
    members = inside.join(stats.select("cluster", "blocks"), "cluster").select("cluster", "rep", "blocks")
    texts = docs.withColumnRenamed("doc_id", "rep")
    equal = _links(members, stats, "cluster", lambda rows: rows.join(texts, "rep"), _near_sets(width, percent), SET_BLOCK, SET_BLOCK_SHINGLES, scratch, "sets")
    linked = components(equal, scratch, "links")

    rooted = classes.select("set_key", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sketch.join(rooted, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
