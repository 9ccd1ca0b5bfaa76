"""Vectors on the grid of 1/256: what the operators that group such vectors share. All sums and distances are whole numbers."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

STEPS = 256


def largest(width: int) -> int:
    """Components up to this size keep four times a squared distance over `width` components below 2**62."""
    return isqrt(2**60 // width) // 2


def plain_vectors(df: DataFrame, column: str = "embedding"):
    """The vector column as arrays of floats or doubles."""
    kind = df.schema[column].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))
    return F.col(column) if plain else F.col(column).cast("array<double>")


def on_grid(column: pa.Array, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of that width without null, non-finite or oversized components, and floor(256 * x) of them."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(all="ignore"):
        cells = np.floor(values * STEPS)
        fine = (np.abs(cells) <= most).all(axis=1)
    return rows[fine], cells[fine].astype(np.int64)


def least_rows(rows: DataFrame, n: int, width: int, most: int) -> np.ndarray:
    """Grid vectors of the n rows with the smallest key (null last, ties by the vector). rows: key, v.

    A task keeps the n least of its rows, so at most n rows per task are sorted, and n reach the driver.
    """
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        best = []
        for batch in batches:
            at, cells = on_grid(batch.column("v"), width, most)
            keys = batch.column("key").take(pa.array(at))
            order = pc.sort_indices(keys, null_placement="at_end").to_numpy().astype(np.int64)
            if len(order) > n:  # and all that tie with the n-th
                last = keys[int(order[n - 1])]
                tied = pc.is_null(keys) if not last.is_valid else pc.fill_null(pc.less_equal(keys, last), False)
                order = np.union1d(order[:n], np.flatnonzero(tied.to_numpy(zero_copy_only=False)))
            new = [(k is None, k or 0 if k is None else k, c) for k, c in zip(keys.take(pa.array(order, pa.int64())).to_pylist(), cells[order].tolist(), strict=True)]
            best = sorted(best + new)[:n]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([None if b[0] else b[1] for b in best], rows_type), pa.array([b[2] for b in best], pa.list_(pa.int64()))], ["key", "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows_type = to_arrow_type(rows.schema["key"].dataType)
    least = rows.mapInArrow(run, f"key {kind}, v array<bigint>").orderBy(F.col("key").asc_nulls_last(), "v").limit(n)
    return np.array([r.v for r in least.collect()], np.int64).reshape(-1, width)


class Sums:
    """Sums of grid vectors by group, for one task."""

    def __init__(self, groups: int, width: int):
        self.n, self.sums = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)

    def add(self, group: np.ndarray, cells: np.ndarray):
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        if len(first):
            who = group[order][first]
            self.sums[who] += np.add.reduceat(cells[order], first, axis=0)
            self.n += np.bincount(group, minlength=len(self.n))

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(self.n[used]), pa.array(self.sums[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "sums"])


SUMS = "slot long, n long, sums array<long>"


def moved(centres: np.ndarray, partial: DataFrame) -> np.ndarray:
    """The centres (slot, component) after each moves to floor(sum / count) of its vectors; unused ones stay.

    partial has a row per task and used slot, so the shuffle does not grow with the rows, and slots * components
    sums reach the driver.
    """
    cells = partial.select("slot", "n", F.posexplode("sums").alias("at", "s")).groupBy("slot", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centres.copy()
    for r in cells.collect():
        out[r.slot, r.at] = int(r.s) // r.n
    return out
