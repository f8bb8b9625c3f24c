"""Nearest neighbours by largest inner product with a forest of random-projection trees.

Trees split a bounded sample of the vectors at medians of random projections. Vectors get one more component that makes
their norms equal, so that the largest inner product is the smallest angle. A query walks all trees with one shared
priority queue, the branch closest to it first, until it has enough leaves; the vectors of those leaves are compared in
full. How many leaves are enough depends on the table and is measured on it: some queries are answered in full first.
Only leaf numbers and the forest are shared; every row is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import stored

#: Vectors the trees are built from at most, those with the smallest hashed ids; and of these in a leaf at most.
SAMPLE, LEAF = 16_384, 32
TREES = 10
#: Leaves of all trees that a query looks into at least.
LEAVES = 60
#: Share of their true neighbours that the leaves must hold for the queries measured, and how many of these there are.
RECALL, PROBES = 0.95, 64
#: Vectors of one leaf that are compared by one task, about.
CHUNK = 4_000


class Forest:
    """Random-projection trees over a sample; a node's children are at 2 * node + 1 and 2 * node + 2."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.norm = float(np.sqrt((sample**2).sum(axis=1).max(initial=0.0)))
        lifted = self.lift(sample)
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
        nodes = (1 << self.depth) - 1
        self.planes = rng.normal(size=(trees, nodes, sample.shape[1] + 1)).astype(np.float32)
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True) if nodes else 1
        self.cuts = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            groups = {0: np.arange(len(sample))}
            for node in range(nodes):
                rows = groups.pop(node)
                at = lifted[rows] @ self.planes[t, node]
                self.cuts[t, node] = cut = np.median(at) if len(at) else 0.0
                groups[2 * node + 1], groups[2 * node + 2] = rows[at < cut], rows[at >= cut]

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with equal norms; longer ones than any of the sample keep theirs."""
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (vectors**2).sum(axis=1)))
        return np.column_stack([vectors, rest]).astype(np.float32)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        lifted, out = self.lift(vectors), np.zeros((len(vectors), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", lifted, self.planes[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node
        return out

    def search(self, query: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the ``wanted`` leaves that are nearest by the least distance to a cut on the way."""
        norm = np.linalg.norm(query)
        lifted = np.append(query / norm * self.norm, 0.0).astype(np.float32)
        first = (1 << self.depth) - 1
        # one queue for all trees: (distance to the farthest side taken so far, tree, node)
        queue, found = [(0.0, t, 0) for t in range(len(self.planes))], []
        margins = np.einsum("tnd,d->tn", self.planes, lifted) - self.cuts
        while queue and len(found) < wanted:
            far, t, node = heapq.heappop(queue)
            while node < first:
                margin = float(margins[t, node])
                near = 2 * node + 1 + (margin >= 0)
                heapq.heappush(queue, (max(far, abs(margin)), t, 4 * node + 3 - near))
                node = near
            found.append((t, node))
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) with finite components, not all zero, of the length that most of them have (the shorter of equally common)."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("embedding", lambda x: x != 0)
    found = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    size = F.size("embedding")
    common = found.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return found.where(size == F.lit(common["size"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _compare(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The ``k`` best candidates of a leaf for each query that looks into it."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"query": pa.array([], pa.int64()), "class_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    ids = right.column("class_id").to_numpy()
    order = np.argsort(ids)
    ids, base = ids[order], _matrix(right.column("embedding").combine_chunks())[order]
    queries, names = _matrix(left.column("embedding").combine_chunks()), left.column("query").to_numpy()
    out = [[], [], []]
    for a in range(0, len(names), 256):
        # a fixed order of the sum, so that equal vectors have equal scores wherever they are compared
        scores = np.einsum("qd,vd->qv", queries[a : a + 256], base, optimize=False)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        out[0].append(np.repeat(names[a : a + 256], best.shape[1]))
        out[1].append(ids[best].ravel())
        out[2].append(np.take_along_axis(scores, best, axis=1).ravel())
    return pa.table({n: np.concatenate(x) for n, x in zip(("query", "class_id", "score"), out)})


def _enough(classes: DataFrame, asked: DataFrame, forest: Broadcast, k: int) -> int:
    """The leaves that hold ``RECALL`` of the ``k`` nearest others of up to ``PROBES`` queries, all rows compared."""
    chosen = asked.select("class_id").distinct().orderBy(F.xxhash64("class_id"), "class_id").limit(PROBES)
    rows = classes.join(F.broadcast(chosen), "class_id").select("class_id", "embedding").collect()
    if not rows:
        return LEAVES
    probes, names = np.array([r["embedding"] for r in rows], np.float64), np.array([r["class_id"] for r in rows])

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, ids = _matrix(batch.column("embedding")), batch.column("class_id").to_numpy()
            scores = np.where(names[:, None] == ids, -np.inf, probes @ base.T)
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            used, place = np.unique(at, return_inverse=True)
            leaf = list(forest.value.leaves(base[used])) if len(used) else []
            score = np.take_along_axis(scores, at, axis=1).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, at.shape[1])), pa.array(ids[at].ravel()), pa.array(score),
                 pa.array([leaf[i] for i in place.ravel()], pa.list_(pa.int64()))],
                ["query", "class_id", "score", "places"],
            )

    order = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    found = classes.select("class_id", "embedding").mapInArrow(best, "query bigint, class_id bigint, score double, places array<bigint>")
    true = found.withColumn("turn", F.row_number().over(order)).where((F.col("turn") <= k) & (F.col("score") > float("-inf"))).collect()
    total = len(forest.value.planes) << forest.value.depth
    # when a walk through all leaves comes to each of them
    walks = {n: {at: i for i, at in enumerate(forest.value.search(q, total))} for n, q in zip(names, probes)}
    turns = sorted(min(walks[r["query"]][t, leaf] for t, leaf in enumerate(r["places"])) for r in true)
    return max(LEAVES, turns[int(np.ceil(RECALL * len(turns))) - 1] + 1) if turns else LEAVES


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, leaves: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` its ``k`` nearest others found.

    A query looks into ``leaves`` leaves; None: as many as hold ``RECALL`` of the true neighbours of some queries.
    Nearness is the inner product in double precision, ties go to the smaller vec_id; with fewer other rows all of them.
    Rows with a null id, or a vector that is null, zero, of another length or with null or non-finite components take no
    part. Equal vectors are indexed once and come out each; rows with one vec_id count as one. No usable row: no rows.
    Further columns don't matter.
    """
    session = vectors.sparkSession
    rows = usable(vectors).dropDuplicates(["vec_id"])
    # of equal vectors the k + 1 smallest ids are all that any query can need
    turn = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k + 1)
    classes = stored(
        first.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors"
    )
    asked = stored(
        rows.where(F.col("vec_id") % every == 0).join(classes.select("class_id", "embedding"), "embedding").select("vec_id", "class_id"),
        "queries",
    )
    sample = [r[0] for r in classes.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("embedding").collect()]
    if not sample:
        return session.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    forest = session.sparkContext.broadcast(Forest(np.array(sample, np.float64), trees, LEAF))
    chunks = 1 + classes.count() // (CHUNK << forest.value.depth)
    wanted_leaves = _enough(classes, asked, forest, k) if leaves is None else leaves

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = forest.value.leaves(_matrix(batch.column("embedding")))
            ids = batch.column("class_id").to_numpy()
            for t in range(places.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), t, np.int32)), pa.array(places[:, t]), pa.array((ids % chunks).astype(np.int32)),
                     batch.column("class_id"), batch.column("embedding")],
                    ["tree", "leaf", "chunk", "class_id", "embedding"],
                )

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest.value.search(q, wanted_leaves) for q in _matrix(batch.column("embedding"))]
            at = np.repeat(np.arange(len(found)), list(map(len, found)))
            tree, leaf = np.array([x for f in found for x in f], np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree.astype(np.int32)), pa.array(leaf), batch.column("class_id").take(pa.array(at)),
                 batch.column("embedding").take(pa.array(at))],
                ["tree", "leaf", "query", "embedding"],
            )

    placed = classes.select("class_id", "embedding").mapInArrow(
        index, "tree int, leaf bigint, chunk int, class_id bigint, embedding array<double>"
    )
    wanted = classes.join(asked.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "embedding").mapInArrow(
        walk, "tree int, leaf bigint, query bigint, embedding array<double>"
    ).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keys = ["tree", "leaf", "chunk"]
    compared = wanted.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(
        lambda left, right: _compare(left, right, k + 1), "query bigint, class_id bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    top = compared.distinct().withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= k + 1)
    each = top.join(classes.select("class_id", "ids"), "class_id").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k + 1)
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query")).join(each, "query").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
