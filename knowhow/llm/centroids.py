"""Centroid clustering: nearest centroids by the threshold algorithm over per-component sorted lists."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import saved
from knowhow.llm.grids import SUMS, Sums, largest, least_rows, moved, on_grid, plain_vectors

BLOCK = 1024
FAR = 1 << 30


class SortedLists:
    """For each component, the centroids in the order of their value there."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.k, self.width = centres.shape
        order = np.argsort(centres, axis=0, kind="stable").T
        value = np.take_along_axis(centres.T, order, 1)
        self.value = value.astype(np.int32)
        # A list's ends are too far away to be taken before the other side is used up.
        end, nobody = np.full((self.width, 1), FAR), np.full((self.width, 1), self.k)
        self.walk = np.concatenate([-end, value, end], axis=1).astype(np.int32).ravel()
        self.who = np.concatenate([nobody, order, nobody], axis=1).ravel()

    def nearest(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (ties to the smaller number) and squared distance of each row.

        Every list is walked outward from the vector's value, one entry per component and step. Centroids met for
        the first time get their exact distance. A centroid not met yet is at least as far in each component as
        the entry met last, so once the sum of these squares exceeds the best distance the search is over.
        """
        n, k = len(cells), self.k
        number, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        live = np.arange(n)
        x, exact = cells.astype(np.int32), cells
        low = np.empty((n, self.width), np.int32)
        for d in range(self.width):
            low[:, d] = np.searchsorted(self.value[d], x[:, d], "right") + d * (k + 2)
        high = low + 1
        met = np.zeros((n, k + 1), bool)
        met[:, k] = True
        for _ in range(k):
            below, above = x - self.walk[low], self.walk[high] - x
            down = below <= above
            new = np.zeros_like(met)
            new[np.arange(len(live))[:, None], self.who[np.where(down, low, high)]] = True
            new &= ~met
            met |= new
            row, centre = np.nonzero(new)
            gap = exact[row] - self.centres[centre]
            distance = np.full((len(live), k), np.iinfo(np.int64).max)
            distance[row, centre] = np.einsum("ij,ij->i", gap, gap)
            first = distance.argmin(axis=1)
            least = distance[np.arange(len(live)), first]
            better = (least < best[live]) | ((least == best[live]) & (first < number[live]))
            number[live[better]], best[live[better]] = first[better], least[better]
            frontier = np.minimum(below, above).astype(np.int64)
            on = (np.einsum("ij,ij->i", frontier, frontier) <= best[live]) & ~met.all(axis=1)
            if not on.any():
                break
            low, high = (low - down)[on], (high + ~down)[on]
            live, x, exact, met = live[on], x[on], exact[on], met[on]
        return number, best


def _blocks(batches, width: int, most: int):
    for batch in batches:
        at, cells = on_grid(batch.column("v"), width, most)
        for k in range(0, len(at), BLOCK):
            yield batch, at[k : k + BLOCK], cells[k : k + BLOCK]


def _sums(centres: np.ndarray, most: int):
    def run(batches):
        lists, sums = SortedLists(centres), Sums(*centres.shape)
        for _, _, cells in _blocks(batches, centres.shape[1], most):
            sums.add(lists.nearest(cells)[0], cells)
        yield sums.batch()

    return run


def _assigned(centres: np.ndarray, most: int):
    def run(batches):
        lists = SortedLists(centres)
        for batch, at, cells in _blocks(batches, centres.shape[1], most):
            number, best = lists.nearest(cells)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


def _limit(width: int) -> int:
    return min(largest(width), FAR // 8)


def centroids(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64) -> np.ndarray:
    """(centroid, component) on the grid of 1/256; fewer than k rows where there are fewer usable vectors. See clustered.

    A round is one scan: tasks add up their vectors by centroid, Spark adds the tasks' sums, and the k centroids
    go back to the tasks.
    """
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), plain_vectors(vectors).alias("v"))
    centres = least_rows(rows, k, width, _limit(width))
    for _ in range(rounds if len(centres) else 0):
        centres = moved(centres, rows.select("v").mapInArrow(_sums(centres, _limit(width)), SUMS))
    return centres


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of vectors (vec_id, embedding).

    Components become floor(256 * x). The k vectors with the least sha256 of `2:<vec_id>` start (null ids last, repeated
    ids in the order of their vectors); in each round every vector goes to its nearest centroid, ties to the smaller number, and
    centroids move to the floor of the mean; empty ones stay. Distances are squared.

    Vectors that are null, of another length than `width`, or hold null or non-finite components are left out, and
    those with a component beyond largest(): 2**18 for 64 components. Repeated rows count and come out each.
    No usable vector gives an empty table. Other columns are ignored.
    """
    vectors = vectors.select("vec_id", "embedding")
    centres = centroids(vectors, k, rounds, width)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    layout = f"vec_id {kind}, cluster int, distance long"
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], f"{layout}, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = vectors.select("vec_id", plain_vectors(vectors).alias("v"))
    found = saved(rows.mapInArrow(_assigned(centres, _limit(width)), layout), "clustered")
    per = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows at most
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    table = vectors.sparkSession.createDataFrame(
        [(c, n, sum(per.values()), names[c]) for c, n in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
