"""Nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then sent down to its leaf. A query walks
the tree through a priority queue, nearest centre first, and visits leaves in the order in which they
come out. How many leaves suffice is calibrated: for a bounded set of drawn queries the true
neighbours are found by brute force over all vectors, and the visits are widened until the wanted
share of them lies in visited leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelane.llm.common import Scratch, ship

#: Bounds of what is collected: sampled vectors, and queries with known neighbours.
FIT_ROWS, CALIBRATION_QUERIES = 20_000, 64
BRANCH, LEAF_ROWS, MAX_LEAVES = 16, 256, 4096
RECALL = 0.97
#: A task's block of vectors and of queries.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 4096
SALTS = 32
_RNG = 11


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the nearest centre of each row; centres that lose all rows go."""
    centres = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = nearest(x, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros((len(centres), x.shape[1]))
        np.add.at(sums, own, x)
        centres = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres, nearest(x, centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    square = (centres**2).sum(axis=1)
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = (square - 2 * x[at : at + 8192] @ centres.T).argmin(axis=1)
    return out


class Tree:
    """Nodes with a centre; children[n] are the nodes below n, or none, and then n is leaf number leaf[n]."""

    def __init__(self, sample: np.ndarray, rows: int, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS):
        rng = np.random.default_rng(_RNG)
        self.centres, self.children, self.leaf = [sample.mean(axis=0)], [[]], [-1]
        self.leaves = 0
        each = max(1.0, rows / max(len(sample), 1))  # vectors that a sampled one stands for
        queue = [(-len(sample), 0, sample)]
        while queue:
            _, node, own = heapq.heappop(queue)
            enough = len(own) * each > leaf_rows and len(own) >= 2 * branch and self.leaves + len(queue) + branch <= MAX_LEAVES
            groups = kmeans(own, branch, rng) if enough else None
            if groups is None or len(groups[0]) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for c, centre in enumerate(groups[0]):
                self.children[node].append(len(self.centres))
                members = own[groups[1] == c]
                heapq.heappush(queue, (-len(members), len(self.centres), members))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node down to the nearest child."""
        out = np.empty(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            below = nearest(x[rows], self.centres[self.children[node]])
            stack.extend((child, rows[below == c]) for c, child in enumerate(self.children[node]))
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first leaves of a best-bin-first traversal."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < leaves:
            _, node = heapq.heappop(heap)
            if not (below := self.children[node]):
                out.append(self.leaf[node])
                continue
            for far, child in zip(((self.centres[below] - q) ** 2).sum(axis=1).tolist(), below, strict=True):
                heapq.heappush(heap, (far, child))
        return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest rows by Euclidean distance, ties to smaller ids: (query, rows, distances)."""
    for i, one in enumerate(q):
        far = np.sqrt(((x - one) ** 2).sum(axis=1))
        at = np.arange(len(far))
        if len(far) > k:
            at = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
        at = at[np.lexsort((ids[at], far[at]))][:k]
        yield i, at, far[at]


def _top_table(qids: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, k: int) -> pa.RecordBatch:
    found = list(top(q, x, ids, k))
    rows = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    query = np.repeat(qids, [len(f[1]) for f in found])
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids[rows]), pa.array(np.concatenate([f[2] for f in found]) if found else np.zeros(0)), pa.array(leaf[rows])], ["qid", "vec_id", "score", "leaf"])


_FOUND = "qid long, vec_id long, score double, leaf long"


def _k_best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of the commonest length that is finite and not zero."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size("v") == (sizes[0] if sizes else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each distinct vector: others are never among the k nearest of any query.

    A common vector is thinned in SALTS parts first, so none of its rows need to meet in one task.
    """
    key = ["h1", "h2"]
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 as 0.0
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for part in ([*key, "salt"], key):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return rows.select("vec_id", "v", *key)


def search(vectors: DataFrame, is_query, k: int = 10, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of vectors for which is_query(vec_id) holds.

    vectors: (vec_id, embedding). Candidates are all rows but those with the query's own id; score is
    the Euclidean distance in double precision, ties go to the smaller vec_id. Vectors that are null,
    zero, not finite or of an uncommon length take no part, neither do null ids. Rows that
    repeat an id and a vector count once. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = valid_vectors(vectors).select("vec_id", "v").distinct()
    points = scratch.save(distinct_vectors(rows, k), "points")
    asked = scratch.save(rows.where(is_query(F.col("vec_id"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "asked")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = points.count()
    if not n or asked.isEmpty():
        return empty

    draw = F.pmod(F.xxhash64(F.lit(_RNG), "vec_id"), F.lit(1_000_000))
    sample = points.where(draw < -(-1_000_000 * min(fit_rows, n) // n)).select("v").toArrow()
    tree = Tree(matrix(sample.column("v")), n) if sample.num_rows else Tree(matrix(points.limit(1).select("v").toArrow().column("v")), n)
    sent = ship(spark, tree)  # at most 2 * MAX_LEAVES centres

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = sent().assign(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf)], ["vec_id", "v", "leaf"])

    index = scratch.save(points.select("vec_id", "v").mapInArrow(to_leaf, "vec_id long, v array<double>, leaf long"), "index")
    visits = calibrate(tree, index, n, k, recall)

    # A vector that several rows ask for is searched once, for k + 1: one of them may be its own.
    qids = asked.groupBy("h1", "h2").agg(F.min("query_id").alias("qid"))
    each = asked.join(qids, ["h1", "h2"])

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("v"))
                found = [sent().visit(one, visits) for one in q]
                sizes = [len(f) for f in found]
                at = pa.array(np.repeat(np.arange(len(q)), sizes))
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(at), batch.column("v").take(at), pa.array(np.concatenate(found).astype(np.int64))], ["qid", "v", "leaf"])

    probes = scratch.save(each.where("query_id = qid").select("qid", "v").mapInArrow(to_leaves, "qid long, v array<double>, leaf long"), "probes")
    # At most MAX_LEAVES rows each.
    blocks = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("xs")).join(probes.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qs")), "leaf")
    blocks = F.broadcast(blocks)
    x = index.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("xs")).cast("int").alias("xb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "vec_id", "v")
    q = probes.join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"), F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int").alias("qb"), "qid", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "leaf": pa.array([], pa.int64())})
        found = _top_table(left.column("qid").to_numpy(), matrix(left.column("v")), matrix(right.column("v")), right.column("vec_id").to_numpy(), right.column("leaf").to_numpy(), k + 1)
        return pa.Table.from_batches([found])

    cell = ["leaf", "xb", "qb"]
    found = q.groupBy(*cell).cogroup(x.groupBy(*cell)).applyInArrow(meet, _FOUND)
    best = _k_best(found, k + 1).select("qid", "vec_id", "score")
    own = each.select("query_id", "qid").join(best, "qid").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(tree: Tree, index: DataFrame, n: int, k: int, recall: float) -> int:
    """The least number of leaf visits that finds the wanted share of the drawn queries' true neighbours."""
    spark = index.sparkSession
    draw = F.pmod(F.xxhash64(F.lit(_RNG + 1), "vec_id"), F.lit(1_000_000))
    drawn = index.where(draw < max(1, -(-2_000_000 * CALIBRATION_QUERIES // n))).orderBy(draw, "vec_id").limit(CALIBRATION_QUERIES).select("vec_id", "v").toArrow()
    if tree.leaves == 1 or not drawn.num_rows:
        return tree.leaves
    ids, q = drawn.column("vec_id").to_numpy(), matrix(drawn.column("v"))
    sent = ship(spark, (ids, q))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _top_table(*sent(), matrix(batch.column("v")), batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy(), k + 1)

    true = _k_best(index.mapInArrow(brute, _FOUND), k + 1).collect()  # k + 1 rows a drawn query
    place = {int(i): {leaf: at for at, leaf in enumerate(tree.visit(one, tree.leaves))} for i, one in zip(ids, q, strict=True)}
    needed = sorted(place[r["qid"]][r["leaf"]] + 1 for r in true if r["vec_id"] != r["qid"])
    visits = 1
    while needed and np.searchsorted(needed, visits, "right") < recall * len(needed):
        visits += 1
    return visits
