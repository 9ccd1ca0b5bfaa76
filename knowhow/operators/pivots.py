"""Exact self-joins of unit vectors that leave out what the triangle inequality rules out.

Every row belongs to the cell of its nearest pivot; a cell larger than a block is cut into blocks. Of each cell the
largest angle to its own pivot and the range of angles to some common pivots are known, so that of two blocks only rows
are multiplied that may find one within their angle in the other's cell. That angle comes from the threshold, or from the k best rows of the row's own
block. How much is left out depends on the vectors: clustered ones meet few cells, evenly spread ones in many dimensions
meet nearly all of them, which is then what meeting every block costs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow.operators import blocks
from knowhow.session import cut_lineage

#: What goes to every task is bounded: so many pivots, and angles to so many of them per cell.
MOST_PIVOTS = 1024
COMMON = 32
#: Room for rounding: similarities have six digits, and an arc cosine loses half of a double's.
SLACK = 1e-6
_COPY_ROWS = 8192


def angle(sim):
    """The largest angle at which a rounded similarity of ``sim`` is possible."""
    return np.arccos(np.clip(np.asarray(sim, dtype=float) - SLACK, -1.0, 1.0)) + SLACK


def units(vecs: pa.Array) -> np.ndarray:
    """Unit vectors as rows; a zero vector stays zero and so is at a right angle to everything."""
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    mat = flat.reshape(len(vecs), -1) if len(vecs) else np.zeros((0, 1))
    length = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
    return mat / np.where(length == 0, 1.0, length)


@dataclass(frozen=True)
class Cells:
    """Pivots, and per cell its radius, its angles' range to the common pivots, and its first block and their number."""

    pivots: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    blocks: np.ndarray


def choose_pivots(df: DataFrame, n: int) -> np.ndarray:
    """At most n pivots among the 4 n rows of least hash, each the farthest from those before it."""
    rows = df.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(4 * n).toArrow()
    mat = np.unique(units(rows.column("vec").combine_chunks()), axis=0)
    mat = mat[(mat * mat).sum(axis=1) > 0]
    if not len(mat):
        return np.zeros((1, units(rows.column("vec").combine_chunks()).shape[1]))
    chosen, nearest = [0], mat @ mat[0]
    while len(chosen) < min(n, len(mat)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, mat @ mat[chosen[-1]])
    return mat[chosen]


def _angles(mat, pivots):
    return np.arccos(np.clip(mat @ pivots.T, -1.0, 1.0))


def _ranges(pivots):
    """For one task: per cell the number of its rows and the range of their angles to the common pivots and to its own; a row's cell is
    that of the nearest pivot where it has none yet."""
    common = min(COMMON, len(pivots))

    def run(batches):
        n = np.zeros(len(pivots), dtype=np.int64)
        low, high = np.full((len(pivots), common + 1), np.inf), np.full((len(pivots), common + 1), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, _COPY_ROWS):
                part = batch.slice(at, _COPY_ROWS)
                to = _angles(units(part.column("vec")), pivots)
                own = part.column("_cell").to_numpy() if "_cell" in part.schema.names else to.argmin(axis=1)
                seen = np.column_stack([to[:, :common], to[np.arange(len(own)), own]])
                np.minimum.at(low, own, seen)
                np.maximum.at(high, own, seen)
                np.add.at(n, own, 1)
        cell, place = (x.ravel() for x in np.indices(low.shape))
        held = n[cell] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[held]) for x in (cell, place, low.ravel(), high.ravel(), n[cell])], ["cell", "place", "low", "high", "n"]
        )

    return run


def build_cells(df: DataFrame, n_rows: int, block_rows: int, pivots: np.ndarray | None = None) -> Cells:
    """About four cells per block of rows; two passes over the rows, and a table of cells by common pivots comes back.

    With ``pivots`` the rows' cells are given as _cell.
    """
    given = [] if pivots is None else ["_cell"]
    pivots = choose_pivots(df, min(MOST_PIVOTS, math.ceil(4 * n_rows / block_rows))) if pivots is None else pivots
    found = df.select("vec", *given).mapInArrow(_ranges(pivots), "cell long, place long, low double, high double, n long")
    table = found.groupBy("cell", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
    cell, place = table.column("cell").to_numpy(), table.column("place").to_numpy()
    common = min(COMMON, len(pivots))
    low, high = np.full((len(pivots), common + 1), np.inf), np.full((len(pivots), common + 1), -np.inf)
    low[cell, place], high[cell, place] = table.column("low").to_numpy(), table.column("high").to_numpy()
    n = np.zeros(len(pivots), dtype=np.int64)
    n[cell] = table.column("n").to_numpy()
    blocks = -(-n // block_rows)
    return Cells(pivots, high[:, common], low[:, :common], high[:, :common], np.cumsum(blocks) - blocks, blocks)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + more


def _columns(batch, names, more):
    """The named columns, and further ones from arrays."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(v) for v in more.values()], [*names, *more])


def _nearest(batch, pivots):
    return _angles(units(batch.column("vec")), pivots).argmin(axis=1)


def _kept_together(df: DataFrame, pivots: np.ndarray, keys: list[str]) -> DataFrame:
    """Rows with a _cell, one for all rows with the same keys: the first of those that are nearest to one of them."""
    names = df.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _COPY_ROWS):
                part = batch.slice(at, _COPY_ROWS)
                yield _columns(part, names, {"_cell": _nearest(part, pivots).astype(np.int32)})

    near = df.mapInArrow(run, _schema(df, "_cell int"))
    return cut_lineage(near.withColumn("_cell", F.min("_cell").over(Window.partitionBy(*keys))))


def _dealt(cells, names):
    """Every row with its cell and its block; the rows of a large cell are dealt to its blocks by ``_hash``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _COPY_ROWS):
                part = batch.slice(at, _COPY_ROWS)
                own = part.column("_cell").to_numpy() if "_cell" in part.schema.names else _nearest(part, cells.pivots)
                spread = part.column("_hash").to_numpy() % cells.blocks[own]
                yield _columns(part, names, {"_cell": own.astype(np.int32), "_own": (cells.first[own] + spread).astype(np.int32)})

    return run


def _reaching(cells, thresholds, table, own, other, nearest=True):
    """Which rows of a block of the cell ``own`` may find, or be found by, a row of the cell ``other``. ``nearest``: every row is in the
    cell of its nearest pivot."""
    common = cells.low.shape[1]
    to = _angles(units(table.column("vec").combine_chunks()), cells.pivots[np.r_[np.arange(common), other, own]])
    theta = table.column("_theta").to_numpy()
    if thresholds is not None:
        theta = np.maximum(theta, thresholds[other])
    near = to[:, common] <= cells.radius[other] + theta
    if nearest:
        near &= to[:, common] - to[:, common + 1] <= 2 * theta  # s is nearer to its own pivot
    for p in range(common):
        near &= (cells.low[other, p] - theta <= to[:, p]) & (to[:, p] <= cells.high[other, p] + theta)
    return near


@dataclass(frozen=True)
class Tiles:
    """Written blocks (_own, _cell, rows) of (id, vec, optionally grp, _theta), and what tells which rows of two blocks can match.

    Without cells every row meets every other.
    """

    blocks: DataFrame
    cells: Cells | None = None
    thresholds: np.ndarray | None = None
    nearest: bool = True

    def apply(self, kernel: Callable, schema: str, combine: Callable | None = None) -> DataFrame:
        """``kernel(key, left, right)`` for every pair of blocks in which some rows can match, lower block first."""
        cells, thresholds, nearest = self.cells, self.thresholds, self.nearest

        def run(key, left, right):
            a, b = key["l__cell"], key["r__cell"]
            if cells is not None and a != b:
                left = left.filter(pa.array(_reaching(cells, thresholds, left, a, b, nearest)))
                right = right.filter(pa.array(_reaching(cells, thresholds, right, b, a, nearest)))
                if not len(left) or not len(right):
                    return None
            return kernel((key["l__own"], key["r__own"]), left, right)

        return blocks.pair_up(self.blocks, "l__own <= r__own", run, schema, combine)

    def compared(self) -> int:
        """How many pairs of rows the kernel will multiply."""
        def count(key, left, right):
            n = len(left) * (len(left) - 1) // 2 if key[0] == key[1] else len(left) * len(right)
            return pa.table({"n": pa.array([n], pa.int64())})

        return int(self.apply(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def plain_tiles(df: DataFrame, n_blocks: int) -> Tiles:
    """Every row with every other: blocks by hash."""
    own = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    return Tiles(blocks.packed(df.withColumn("_own", own).withColumn("_cell", F.lit(0)), ["_own", "_cell"], n_blocks))


def tiles(df: DataFrame, n_rows: int, block_rows: int, threshold: float | None = None,
          inside: Callable | None = None, together: list[str] | None = None) -> Tiles:
    """Which pairs of blocks have to be compared, with the rows that each needs. Rows with the same ``together`` lie in one block.

    With ``threshold`` a row's angle is the threshold's. Otherwise ``inside(table)`` gives for the rows of one block,
    in their order, the similarity that a row must reach to count for them (-1 where everything still counts).
    """
    names = df.columns
    df = cut_lineage(df)
    if together:
        pivots = choose_pivots(df, min(MOST_PIVOTS, math.ceil(4 * n_rows / block_rows)))
        df = _kept_together(df, pivots, together)
        cells = build_cells(df, n_rows, block_rows, pivots)
    else:
        cells = build_cells(df, n_rows, block_rows)
    dealt = df.withColumn("_hash", F.pmod(F.xxhash64(*(together or ["id", "vec"])), F.lit(1 << 30))).mapInArrow(
        _dealt(cells, names), _schema(df.select(*names), "_cell int, _own int")
    )
    if inside is None:
        rows, thresholds = dealt.withColumn("_theta", F.lit(float(angle(threshold)))), None
    else:
        def with_angle(table):
            return table.append_column("_theta", pa.array(angle(inside(table.combine_chunks()))))

        rows = cut_lineage(dealt.groupBy("_own").applyInArrow(with_angle, _schema(dealt, "_theta double")))
        thresholds = np.zeros(len(cells.pivots))
        for cell, theta in rows.groupBy("_cell").agg(F.max("_theta")).collect():  # a number per pivot
            thresholds[cell] = theta
    return Tiles(blocks.packed(rows, ["_own", "_cell"], int(cells.blocks.sum())), cells, thresholds, not together)
