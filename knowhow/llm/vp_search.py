"""Nearest neighbours by inner product with vantage-point trees, one per shard."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow.llm.common import saved

LEAF = 128


class VantageTree:
    """Distinct vectors of a shard; the inner product becomes a distance by one more coordinate that lifts every
    vector to the length of the longest. Each inner node splits its vectors by the distance to one of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, spare: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        # Of equal vectors only the least ids can be among the nearest: `spare` of them are enough for any query.
        rank = np.arange(len(ids)) - np.flatnonzero(new)[group]
        self.ids, self.owner = ids[rank < spare], group[rank < spare]
        self.vectors = vectors[new]
        square = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.reach = float(square.max())
        self.points = np.column_stack([self.vectors, np.sqrt(np.maximum(self.reach - square, 0))])
        self.order = np.arange(len(self.points))
        self.nodes: list[tuple] = []  # (first, end, vantage, radius bounds of the near side, of the far side, near child, far child)
        self._build(0, len(self.order), np.random.default_rng(0))

    def _build(self, first: int, end: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append((first, end, -1, 0.0, 0.0, 0.0, 0.0, -1, -1))
        if end - first > LEAF:
            mine = self.order[first:end]
            vantage = int(mine[rng.integers(len(mine))])
            d = np.sqrt(np.maximum(((self.points[mine] - self.points[vantage]) ** 2).sum(axis=1), 0))
            by = np.argsort(d, kind="stable")
            self.order[first:end], d = mine[by], d[by]
            half = len(mine) // 2
            near, far = self._build(first, first + half, rng), self._build(first + half, end, rng)
            self.nodes[me] = (first, end, vantage, d[0], d[half - 1], d[half], d[-1], near, far)
        return me

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) numbers of candidates among which each query's k best distinct vectors are if factor is 1.

        All queries walk down together. A side is left out for the queries whose k-th distance so far is below
        factor times the least distance that the triangle inequality allows there: at 1 nothing can be missed.
        """
        lifted = np.column_stack([queries, np.zeros(len(queries))])
        square = np.einsum("ij,ij->i", lifted, lifted)
        kth = np.full(len(queries), np.inf)
        best = np.full((len(queries), k), np.inf)
        picked = np.full((len(queries), k), -1)

        def leaf(first, end, q):
            mine = self.order[first:end]
            d = square[q][:, None] + self.reach - 2 * queries[q] @ self.vectors[mine].T
            both = np.concatenate([best[q], d], axis=1)
            who = np.concatenate([picked[q], np.broadcast_to(mine, d.shape)], axis=1)
            at = np.argpartition(both, k - 1, axis=1)[:, :k]
            best[q], picked[q] = np.take_along_axis(both, at, 1), np.take_along_axis(who, at, 1)
            kth[q] = np.sqrt(np.maximum(best[q].max(axis=1), 0))

        def walk(node, q):
            first, end, vantage, a, b, c, e, near, far = self.nodes[node]
            if vantage < 0:
                leaf(first, end, q)
                return
            d = np.sqrt(np.maximum(((lifted[q] - self.points[vantage]) ** 2).sum(axis=1), 0))
            bound = np.column_stack([np.maximum(np.maximum(a - d, d - b), 0), np.maximum(np.maximum(c - d, d - e), 0)])
            nearer = bound[:, 0] <= bound[:, 1]
            for side, child in ((nearer, near), (~nearer, far)):
                if side.any():
                    walk(child, q[side])
            for side, child, column in ((~nearer, near, 0), (nearer, far, 1)):
                ask = side & (factor * bound[:, column] <= kth[q] + 1e-6)
                if ask.any():
                    walk(child, q[ask])

        walk(0, np.arange(len(queries)))
        q, v = np.nonzero(picked >= 0)
        return q, picked[q, v]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, owner=self.owner, vectors=self.vectors, points=self.points, order=self.order, reach=self.reach, nodes=np.array(self.nodes))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> VantageTree:
        me = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            me.ids, me.owner, me.vectors, me.points, me.order, me.reach = (z[k] for k in ("ids", "owner", "vectors", "points", "order", "reach"))
            me.reach = float(me.reach)
            me.nodes = [(int(r[0]), int(r[1]), int(r[2]), *r[3:7].tolist(), int(r[7]), int(r[8])) for r in z["nodes"]]
        return me


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _index(spare: int):
    def run(key, t):
        tree = VantageTree(t.column("id").to_numpy(), _matrix(t.column("v")), spare)
        return pa.table({"shard": [key[0].as_py()], "tree": pa.array([tree.dump()], pa.binary())})

    return run


def _search(k: int, factor: float):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                tree = VantageTree.load(batch.column("tree")[row].as_py())
                ids = np.array(batch.column("ids")[row].as_py(), np.int64)
                queries = np.array(batch.column("vs")[row].as_py(), np.float64)
                # One more than asked for: a query may find itself.
                q, v = tree.search(queries, min(k + 1, len(tree.vectors)), factor)
                first = np.searchsorted(tree.owner, v, "left")
                many = np.searchsorted(tree.owner, v, "right") - first
                q, v = np.repeat(q, many), np.repeat(v, many)
                at = np.repeat(first, many) + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
                # Sums in a fixed order, so that equal vectors get equal scores wherever they are.
                score = (queries[q] * tree.vectors[v]).sum(axis=1)
                keep = tree.ids[at] != ids[q]
                q, score, near = q[keep], score[keep], tree.ids[at][keep]
                order = np.lexsort((near, -score, q))
                q, score, near = q[order], score[order], near[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
                top = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[top]]), pa.array(near[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.3, shard_rows: int = 8192, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all vectors but those with its own id.

    vectors, queries: vec_id, embedding (array of numbers, equal lengths). Nearness is the inner product in double
    precision, ties go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do null ids; of repeated ids with equal vectors one counts. Every vector is in a tree: ids are
    hashed into shards of about shard_rows rows, each shard's tree is built once and written. Blocks of queries meet
    every shard, each pair of block and shard is one row of work, and each gives at most k rows per query. factor 1
    searches exactly, larger ones prune more and may miss neighbours.
    """
    def usable(df):
        v = F.col("embedding")
        fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").alias("id"), v.cast("array<double>").alias("v"))

    rows = usable(vectors).dropDuplicates(["id", "v"])
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    trees = saved(dealt.groupBy("shard").applyInArrow(_index(k + 1), "shard long, tree binary"), "trees")
    asked = usable(queries).dropDuplicates(["id"])
    blocks = max(1, -(-queries.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
    asked = asked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("qs"))
    asked = saved(asked.select("block", F.col("qs.id").alias("ids"), F.col("qs.v").alias("vs")), "queries")
    work = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    work = work.join(trees, "shard").repartition("shard", "block")
    found = work.select("ids", "vs", "tree").mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
