"""Exact inner-product top-k by KD-trees per shard.

Vectors become integers floor(scale * x). The first median splits (on the widest side, of a bounded sample of at most
``SAMPLE`` vectors) cut space into leaves; every vector goes to its leaf, and a leaf with more than ``shard_rows`` vectors
is split again by a hash, so many equal vectors make several shards. Each leaf has a tight bounding box of all its
vectors. A query first searches the leaf with the best box bound; the kth score found there is carried to the others,
and the query goes only to leaves whose bound reaches it. In a shard a KD-tree with median splits and tight boxes is visited
best first until the best bound left is below the query's kth score. A task holds one shard and at most about
``block_rows`` queries; a shard is copied only for the blocks of queries that ask it.

Defined cases: vectors that are null, hold a null or non-finite component, or have a null id take no part; only vectors
of the query's length are compared; rows with the query's own id are no candidates; of repeated equal rows each is a
candidate, and each repeated query row has its own answer; ties go to the smaller id; scores beyond a bigint are held
at its ends; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.storage import materialize

#: Vectors that the first splits are fitted on, and leaves they make, at most.
SAMPLE, LEAVES = 16_384, 4096
LEAF = 64
EXACT = float(1 << 52)


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries and boxes, with room for rounding where sums are not exact."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = up @ high.T + down @ low.T
    size = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
    return np.where(size < EXACT, bound, bound + size * (queries.shape[1] + 2) * 2.0**-51)


class KdTree:
    """A shard's tree over whole coordinates held as float64; ``ids`` may repeat.

    ``exact`` holds the same points for scoring: floats where every sum of products is exact, else Python integers."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF, exact: np.ndarray | None = None):
        self.points, self.ids, self.nodes, self.exact = points, ids, [], points if exact is None else exact
        self._build(np.arange(len(points)), leaf)
        self.low = np.array([n[0] for n in self.nodes])
        self.high = np.array([n[1] for n in self.nodes])

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        own = self.points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.nodes)
        self.nodes.append([low, high, rows, None])
        side = int(np.argmax(high - low)) if own.shape[1] else 0
        if len(rows) > leaf and own.shape[1] and high[side] > low[side]:
            order = np.argsort(own[:, side], kind="stable")
            half = len(rows) // 2
            self.nodes[at][3] = (self._build(rows[order[:half]], leaf), self._build(rows[order[half:]], leaf))
            self.nodes[at][2] = None
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No less than the largest inner product each query could have with a point in each node's box."""
        return box_bounds(queries, self.low, self.high)

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: float) -> list[tuple]:
        """The up to k best (score, -id, row) that can still enter a top-k whose kth score is ``floor``."""
        best: list[tuple] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            kth = max(floor, best[0][0]) if len(best) == k else floor
            if -bound < kth:
                break
            _, _, rows, children = self.nodes[at]
            if children:
                for child in children:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            scores = self.exact[rows] @ query
            for i in np.flatnonzero(scores >= kth).tolist():
                item = (int(scores[i]), -int(self.ids[rows[i]]), int(rows[i]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def _matrix(column: pa.ChunkedArray | pa.Array, scale: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(n, len(flat) // n if n else 0)


def _integers(points: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers, for coordinates beyond exact floating point."""
    return np.array([[int(x) for x in p] for p in points.tolist()], object).reshape(points.shape)


def search_shard(queries: pa.Table, shard: pa.Table, k: int, scale: int) -> pa.Table:
    """Top-k candidates of one shard for one block of queries."""
    out: list[tuple] = []
    if queries.num_rows and shard.num_rows:
        q, points = _matrix(queries.column("vector"), scale), _matrix(shard.column("vector"), scale)
        ids, copies = queries.column("vec_id").to_pylist(), shard.column("copies").to_pylist()
        size = (np.abs(q).max(initial=0) * np.abs(points).max(initial=0)) * max(1, q.shape[1])
        exact = size < EXACT
        tree = KdTree(points, shard.column("vec_id").to_numpy(), exact=None if exact else _integers(points))
        asked = q if exact else _integers(q)
        floors = [-np.inf if f is None else f for f in queries.column("floor").to_pylist()]
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        for at in range(0, len(q), 1024):
            for i, bounds in enumerate(tree.bounds(q[at : at + 1024]), at):
                best = tree.search(asked[i], bounds, ids[i], k, floors[i])
                out += [(ids[i], queries.column("query_key")[i].as_py(), -j, clip(score), copies[row]) for score, j, row in best]
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score", "copies"])


class Splits:
    """The first median splits of space: node arrays side, cut, and children (a negative child is leaf -child - 1)."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.side, self.cut, self.children, self.leaves = [], [], [], 0
        self.root = self._split(points, leaves)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        spread = points.max(axis=0) - points.min(axis=0) if len(points) and points.shape[1] else np.zeros(1)
        side = int(np.argmax(spread))
        if leaves < 2 or not spread[side] > 0:
            self.leaves += 1
            return -self.leaves
        values = np.sort(points[:, side])
        cut = values[len(values) // 2] if values[len(values) // 2] > values[0] else values[values > values[0]][0]
        at = len(self.side)
        self.side.append(side)
        self.cut.append(cut)
        self.children.append(None)
        below = points[:, side] < cut
        self.children[at] = (self._split(points[below], leaves // 2), self._split(points[~below], leaves - leaves // 2))
        return at

    def leaf(self, points: np.ndarray) -> np.ndarray:
        now = np.full(len(points), self.root)
        side, cut, children = np.array(self.side, int), np.array(self.cut), np.array(self.children, int).reshape(-1, 2)
        while len(open_ := np.flatnonzero(now >= 0)):
            at = now[open_]
            now[open_] = children[at, (points[open_, side[at]] >= cut[at]).astype(int)]
        return -now - 1


def _by_dim(batch: pa.RecordBatch, scale: int):
    """(dim, row numbers, their matrix) of a batch with columns dim and vector."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, _matrix(batch.column("vector").take(pa.array(rows)), scale)


class TopkIndex:
    """All vectors in leaves, with the box of each leaf.

    The driver holds the sample while it fits the splits, and a box for each leaf: bounded by SAMPLE and LEAVES."""

    def __init__(self, vectors: DataFrame, scale: int = 256, shard_rows: int = 1 << 14):
        self.scale, self.shard_rows = scale, shard_rows
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
        own = own.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("dim"))
        own = materialize(own.groupBy("vec_id", "vector", "dim").agg(F.count("*").alias("copies")), "vectors")
        total = own.count()
        some = own.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE).select("dim", "vector").toArrow()
        leaves = min(LEAVES, max(1, -(-total // shard_rows)))
        splits = {dim: Splits(points, leaves) for batch in some.combine_chunks().to_batches() for dim, _, points in _by_dim(batch, scale)}
        shared = own.sparkSession.sparkContext.broadcast(splits)

        def place(batches):
            for batch in batches:
                leaf = np.zeros(batch.num_rows, np.int32)
                for dim, rows, points in _by_dim(batch, scale):
                    if dim in shared.value:
                        leaf[rows] = shared.value[dim].leaf(points)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

        placed = materialize(own.mapInArrow(place, "vec_id long, vector array<double>, dim int, copies long, leaf int"), "placed")
        sizes = placed.groupBy(F.col("dim").alias("s_dim"), F.col("leaf").alias("s_leaf")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"))
        placed = placed.join(F.broadcast(sizes), (F.col("dim") == F.col("s_dim")) & (F.col("leaf") == F.col("s_leaf"))).drop("s_dim", "s_leaf")
        self.placed = placed.withColumn("sub", F.pmod(F.xxhash64("vec_id", "vector"), F.col("subs")).cast("int"))
        self.boxes = self._boxes()

    def _boxes(self) -> dict:
        """By dim: (leaf numbers, lower corners, upper corners)."""
        scale, kind = self.scale, "dim int, leaf int, low array<double>, high array<double>"

        def box(table: pa.RecordBatch):
            leaves = table.column("leaf").to_numpy()
            for leaf in np.unique(leaves).tolist():
                rows = pa.array(np.flatnonzero(leaves == leaf))
                part = table.take(rows)
                points = _matrix(part.column("vector"), scale)
                yield part.column("dim")[0].as_py(), leaf, points.min(axis=0).tolist(), points.max(axis=0).tolist()

        def parts(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                rows = [x for dim in np.unique(dims).tolist() for x in box(batch.take(pa.array(np.flatnonzero(dims == dim))))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["dim", "leaf", "low", "high"])

        def whole(table: pa.Table) -> pa.Table:
            low, high = (_matrix(table.column(c), 1) for c in ("low", "high"))
            return pa.table([table.column("dim")[:1], table.column("leaf")[:1], pa.array([low.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([high.max(axis=0).tolist()], pa.list_(pa.float64()))], names=["dim", "leaf", "low", "high"])

        found = self.placed.select("dim", "leaf", "vector").mapInArrow(parts, kind).groupBy("dim", "leaf").applyInArrow(whole, kind).collect()
        by_dim: dict = {}
        for row in sorted(found):
            by_dim.setdefault(row.dim, []).append(row)
        return {dim: (np.array([r.leaf for r in rows]), np.array([r.low for r in rows], float).reshape(len(rows), dim), np.array([r.high for r in rows], float).reshape(len(rows), dim)) for dim, rows in by_dim.items()}

    def _routed(self, queries: DataFrame, first: bool) -> DataFrame:
        """A row for each query and leaf: the leaf of the best bound (``first``), or the others whose bound reaches ``floor``."""
        boxes, scale = queries.sparkSession.sparkContext.broadcast(self.boxes), self.scale
        names = ["vec_id", "vector", "dim", "query_key", "floor"]

        def run(batches):
            for batch in batches:
                goal = [(np.zeros(0, int), np.zeros(0, int))]
                floors = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
                for dim, rows, points in _by_dim(batch, scale):
                    leaves, low, high = boxes.value[dim]
                    for at in range(0, len(rows), 256):
                        bounds, some = box_bounds(points[at : at + 256], low, high), rows[at : at + 256]
                        best = np.argmax(bounds, axis=1)
                        if first:
                            goal.append((some, leaves[best]))
                        else:
                            fits = ~(bounds < floors[some, None])
                            fits[np.arange(len(some)), best] = False
                            i, j = np.nonzero(fits)
                            goal.append((some[i], leaves[j]))
                rows, leaf = (np.concatenate(x) for x in zip(*goal))
                for at in range(0, len(rows), 8192):
                    part = batch.take(pa.array(rows[at : at + 8192]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf[at : at + 8192], pa.int32())], names=[*names, "leaf"])

        return queries.select(*names).mapInArrow(run, "vec_id long, vector array<double>, dim int, query_key long, floor double, leaf int")

    def _visit(self, routed: DataFrame, k: int, block_rows: int) -> DataFrame:
        """``query_id, query_key, vec_id, score, copies`` found in the leaves that the queries were routed to."""
        scale = self.scale
        load = routed.groupBy(F.col("dim").alias("l_dim"), F.col("leaf").alias("l_leaf")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        load = load.join(self.placed.select(F.col("dim").alias("p_dim"), F.col("leaf").alias("p_leaf"), "subs").distinct(), (F.col("l_dim") == F.col("p_dim")) & (F.col("l_leaf") == F.col("p_leaf"))).select("l_dim", "l_leaf", "blocks", F.col("subs").alias("l_subs"))
        load = F.broadcast(materialize(load, "topk-load"))  # a row for each leaf
        on = (F.col("dim") == F.col("l_dim")) & (F.col("leaf") == F.col("l_leaf"))
        asked = routed.join(load, on).withColumn("block", F.pmod(F.xxhash64("query_key", F.lit(7)), F.col("blocks")).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("l_subs") - 1)))
        held = self.placed.join(load, on).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["dim", "leaf", "sub", "block"]
        asked, held = asked.select(*keys, "vec_id", "vector", "query_key", "floor"), held.select(*keys, "vec_id", "vector", "copies")

        def run(q: pa.Table, c: pa.Table) -> pa.Table:
            return search_shard(q, c, k, scale)

        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, "query_id long, query_key long, vec_id long, score long, copies long")

    def search(self, every: int = 50, k: int = 5, block_rows: int = 4096) -> DataFrame:
        """``query_id, rank, vec_id, score`` of the rows whose vec_id is divisible by ``every``, against all rows."""
        asked = self.placed.where(F.col("vec_id") % every == 0).select("vec_id", "vector", "dim", F.xxhash64("vec_id", "vector").alias("query_key"), F.col("copies").alias("times"))
        queries = materialize(asked, "topk-queries")
        self.first = materialize(self._routed(queries.withColumn("floor", F.lit(None).cast("double")), True), "topk-routes")
        home = materialize(self._visit(self.first, k, block_rows), "topk-home")
        kth = F.min("score").cast("double")
        reached = home.groupBy("query_key").agg(F.count("*").alias("n"), kth.alias("kth")).where((F.col("n") >= k) & (F.col("kth") > -(2.0**62)))
        reached = reached.select(F.col("query_key").alias("fk"), (F.col("kth") - F.abs("kth") * 2.0**-50).alias("floor"))
        self.others = materialize(self._routed(queries.join(reached, F.col("query_key") == F.col("fk"), "left").drop("fk"), False), "topk-routes")
        found = home.unionByName(self._visit(self.others, k, block_rows))
        order = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = found.withColumn("before", before).where(F.col("before") < k)
        ranks = F.sequence(F.col("before") + 1, F.least(F.lit(k).cast("long"), F.col("before") + F.col("copies")))
        ranked = ranked.withColumn("rank", F.explode(ranks))
        again = queries.where("times > 1").select(F.col("query_key").alias("tk"), "times")
        each = ranked.join(again, F.col("query_key") == F.col("tk"), "left").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1)))))
        return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard_rows: int = 1 << 14, block_rows: int = 4096) -> DataFrame:
    """:meth:`TopkIndex.search` of an index built for it."""
    return TopkIndex(vectors, scale, shard_rows).search(every, k, block_rows)


def oracle(every: int = 50, k: int = 5, scale: int = 256) -> str:
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id) AS copy, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.copy, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, copy ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
