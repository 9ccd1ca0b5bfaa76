"""Cosine search and joins over unit vectors.

A short left side is sent to the tasks that read the right side, which stays where it is: each task keeps the best k per
left row. ``approximate_top_k`` compares with the few rows that a stored index of signatures names. The best k and the pairs
above a cut-off within one frame go by cells around pivots (``pivots.py``). Everything else is
exact and goes by blocks: rows are hashed into equally sized blocks; every pair of blocks meets in one task (within one frame
by reading the two, see ``blocks.py``), which multiplies the two small matrices and keeps only what the caller asked for (best k per row, pairs above a cut-off, counts
per similarity bin, or the full rows of a short left side). No task ever sees more than two blocks, however
the ids, sources or copies are distributed. Similarities are rounded before they are compared, so that ties
are real ties and are settled by id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow.functions.vector import dot, unit
from knowhow.operators import pivots
from knowhow.session import cut_lineage

BLOCK_ROWS = 4096
DIGITS = 6

_PAIR_SCHEMA = "left_id long, right_id long, sim double"
_BIN_SCHEMA = "bin long, n long"


def _matrix(table: pa.Table):
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    vecs = table.column("vec").combine_chunks()
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    mat = flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 1))
    length = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
    length[length == 0] = 1.0
    groups = table.column("grp").combine_chunks().take(pa.array(order)) if "grp" in table.column_names else None
    return ids[order], mat / length, groups


def _shared(left_groups, right_groups, shape):
    """Boolean matrix: the two rows have a group element in common."""
    mask = np.zeros(shape, dtype=bool)
    lv, rv = left_groups.flatten().to_numpy(), right_groups.flatten().to_numpy()
    lrow = np.repeat(np.arange(shape[0]), left_groups.value_lengths().to_numpy())
    rrow = np.repeat(np.arange(shape[1]), right_groups.value_lengths().to_numpy())
    order = np.argsort(rv, kind="stable")
    rv, rrow = rv[order], rrow[order]
    for value in np.intersect1d(lv, rv):
        lo, hi = np.searchsorted(rv, [value, value + 1])
        mask[np.ix_(lrow[lv == value], rrow[lo:hi])] = True
    return mask


def _best(sim, allowed, k):
    """Row, column indexes of the k best allowed columns per row (ties: lower column first)."""
    s = np.where(allowed, sim, -np.inf)
    if s.shape[1] > k:
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((s >= kth) & allowed)
    else:
        rows, cols = np.nonzero(allowed)
    order = np.lexsort((cols, -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    start = np.searchsorted(rows, np.arange(s.shape[0]))
    keep = np.arange(len(rows)) - start[rows] < k
    return rows[keep], cols[keep]


def _counts(lmat, rmat, lgrp, rgrp, digits, schema, rows=1024):
    """How often each rounded similarity of two blocks occurs: all are counted, some rows at a time, and the few of rows with a
    common group element are taken off again."""
    scale = 10**digits
    counts = np.zeros(4 * scale + 1, dtype=np.int64)
    i, j = np.nonzero(_shared(lgrp, rgrp, (len(lmat), len(rmat)))) if lgrp is not None else (np.zeros(0, dtype=int),) * 2
    for at in range(0, len(lmat), rows):
        sim = lmat[at : at + rows] @ rmat.T
        sim *= scale
        np.rint(sim, out=sim)
        sim += 2 * scale
        bins = sim.astype(np.int64)
        seen = np.bincount(bins.ravel())
        counts[: len(seen)] += seen
        lo, hi = np.searchsorted(i, [at, at + rows])
        np.subtract.at(counts, bins[i[lo:hi] - at, j[lo:hi]], 1)
    values = np.flatnonzero(counts)
    return pa.table({"bin": values - 2 * scale, "n": counts[values]}, schema=schema)


def _reached(lmat, rmat, threshold, digits, rows=512):
    """Row, column and rounded similarity of the pairs that reach the threshold, row by row.

    Some rows at a time: products in single precision, with room for their error, name the pairs that are formed and rounded in double precision.
    Where they name many, all are formed in double precision.
    """
    room = (lmat.shape[1] + 4) * 2.0**-23 + 0.6 * 10.0**-digits
    left, right = lmat.astype(np.float32), rmat.astype(np.float32).T
    found, many = [], False
    for at in range(0, len(lmat), rows):
        if not many:
            i, j = np.nonzero(left[at : at + rows] @ right >= np.float32(threshold - room))
            many = len(i) * 64 > len(rmat) * min(rows, len(lmat) - at)
        if many:
            sim = lmat[at : at + rows] @ rmat.T
            i, j = np.nonzero(sim >= threshold - room)
            sim = sim[i, j]
        else:
            sim = np.einsum("ij,ij->i", lmat[at + i], rmat[j])
        sim = np.round(sim, digits)
        over = sim >= threshold
        found.append((at + i[over], j[over], sim[over]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _kernel(mode, k, threshold, digits, is_self, drop_self, schema):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        key = tuple(v.as_py() if isinstance(v, pa.Scalar) else v for v in key)
        lid, lmat, lgrp = _matrix(left)
        rid, rmat, rgrp = _matrix(right)
        if not len(lid) or not len(rid):
            return pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema)
        same_block = is_self and key[0] == key[1]
        if mode == "bins" and not same_block and not drop_self:
            return _counts(lmat, rmat, lgrp, rgrp, digits, schema)
        if mode == "pairs":
            rows, cols, sim = _reached(lmat, rmat, threshold, digits)
            keep = np.ones(len(rows), dtype=bool)
            if lgrp is not None:
                keep &= ~_shared(lgrp, rgrp, (len(lid), len(rid)))[rows, cols]
            a, b = lid[rows], rid[cols]
            if drop_self:
                keep &= a != b
            if same_block:
                keep &= a < b
            if is_self:
                a, b = np.minimum(a, b), np.maximum(a, b)
            return pa.table({"left_id": a[keep], "right_id": b[keep], "sim": sim[keep]}, schema=schema)
        sim = np.round(lmat @ rmat.T, digits)
        allowed = np.ones(sim.shape, dtype=bool)
        if lgrp is not None:
            allowed &= ~_shared(lgrp, rgrp, sim.shape)
        if drop_self:
            allowed &= lid[:, None] != rid[None, :]
        if mode == "top":
            parts = [(lid, rid, sim, *_best(sim, allowed, k))]
            if is_self and not same_block:
                parts.append((rid, lid, sim.T, *_best(sim.T, allowed.T, k)))
            return pa.table(
                {
                    "left_id": np.concatenate([a[r] for a, _, _, r, _ in parts]),
                    "right_id": np.concatenate([b[c] for _, b, _, _, c in parts]),
                    "sim": np.concatenate([s[r, c] for _, _, s, r, c in parts]),
                },
                schema=schema,
            )
        if same_block:
            allowed &= lid[:, None] < rid[None, :]
        if mode == "bins":
            counts = np.bincount(np.rint(sim[allowed] * 10**digits).astype(np.int64) + 2 * 10**digits)
            values = np.flatnonzero(counts)
            return pa.table({"bin": values - 2 * 10**digits, "n": counts[values].astype(np.int64)}, schema=schema)
        rows, cols = np.nonzero(allowed)
        a, b = lid[rows], rid[cols]
        if is_self:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.table({"left_id": a, "right_id": b, "sim": sim[rows, cols]}, schema=schema)

    return run


def _arrow_schema(mode):
    if mode == "bins":
        return pa.schema([("bin", pa.int64()), ("n", pa.int64())])
    return pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("sim", pa.float64())])


def _blocked(df, n_blocks):
    return df.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))


def _n_blocks(df, block_rows):
    return max(1, math.ceil(df.count() / block_rows))


def _kth(k, digits, drop_self):
    """For the rows of one block: the similarity of the k-th best among them, -1 where there are fewer."""

    def run(table: pa.Table) -> np.ndarray:
        ids, mat, groups = _matrix(table)
        sim = np.round(mat @ mat.T, digits)
        allowed = np.ones(sim.shape, dtype=bool)
        if groups is not None:
            allowed &= ~_shared(groups, groups, sim.shape)
        if drop_self:
            allowed &= ids[:, None] != ids[None, :]
        if len(ids) < k:
            return np.full(len(ids), -1.0)
        best = -np.partition(-np.where(allowed, sim, -1.0), k - 1, axis=1)[:, k - 1]
        out = np.empty(len(ids))
        out[np.argsort(table.column("id").to_numpy(), kind="stable")] = best
        return out

    return run


def _self_tiles(df, n, mode, k=None, threshold=None, digits=DIGITS, drop_self=False, block_rows=BLOCK_ROWS):
    inside = _kth(k, digits, drop_self) if mode == "top" else None
    return pivots.tiles(df, n, block_rows, threshold=threshold, inside=inside)


def _best_of(found: pa.Table, k: int) -> pa.Table:
    """The k best rows per left row (ties: lower right id)."""
    left, right, sim = (found.column(c).to_numpy() for c in ("left_id", "right_id", "sim"))
    order = np.lexsort((right, -sim, left))
    first = left[order]
    return found.take(pa.array(order[np.arange(len(order)) - np.searchsorted(first, first) < k]))


def _stars(found: pa.Table) -> pa.Table:
    """As few edges that connect the same rows: every row of a component with its lowest."""
    nodes, ends = np.unique(np.concatenate([found.column("left_id").to_numpy(), found.column("right_id").to_numpy()]), return_inverse=True)
    a, b = ends[: len(found)], ends[len(found) :]
    low = np.arange(len(nodes))
    while (low[a] != low[b]).any():
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], m)
        np.minimum.at(low, low[b], m)
        while (low[low] != low).any():
            low = low[low]
    far = np.flatnonzero(low != np.arange(len(nodes)))
    return pa.table({"left_id": nodes[low[far]], "right_id": nodes[far], "sim": np.full(len(far), np.nan)}, schema=_arrow_schema("pairs"))


def _sum_of(found: pa.Table) -> pa.Table:
    bins, n = found.column("bin").to_numpy(), found.column("n").to_numpy()
    low = bins.min()
    total = np.bincount(bins - low, weights=n)  # exact in a double: one task meets far less than 2**53 pairs
    values = np.flatnonzero(total)
    return pa.table({"bin": values + low, "n": total[values].astype(np.int64)}, schema=found.schema)


def _self_join(df, mode, digits=DIGITS, drop_self=False, block_rows=BLOCK_ROWS, combine=None, **wanted):
    """One block is one task; more rows are dealt to cells, and only rows that may hold a wanted pair meet.

    Blocks are written once and met where they lie (``blocks.py``); a task gives its best, or its counts, for all the blocks it meets.
    """
    n = df.count()
    if n <= block_rows:
        return _join(df, None, mode, digits=digits, drop_self=drop_self, block_rows=block_rows, **wanted)
    run = _kernel(mode, wanted.get("k"), wanted.get("threshold"), digits, True, drop_self, _arrow_schema(mode))
    if mode == "bins":
        return pivots.plain_tiles(df, math.ceil(n / block_rows)).apply(run, _BIN_SCHEMA, _sum_of)
    if combine is None and mode == "top":
        combine = lambda found: _best_of(found, wanted["k"])
    return _self_tiles(df, n, mode, digits=digits, drop_self=drop_self, block_rows=block_rows, **wanted).apply(run, _PAIR_SCHEMA, combine)


def _join(left, right, mode, k=None, threshold=None, digits=DIGITS, drop_self=False, block_rows=BLOCK_ROWS):
    """Columns: id (long), vec (array), optionally grp (array<long>): rows sharing an element never match."""
    schema = _arrow_schema(mode)
    is_self = right is None
    nl = _n_blocks(left, block_rows)
    nr = nl if is_self else _n_blocks(right, block_rows)
    a = _blocked(left, nl)
    b = a if is_self else _blocked(right, nr)
    first_other = F.col("_own") if is_self else F.lit(0)
    last_other = F.col("_own") if is_self else F.lit(nl - 1)
    a = a.withColumn("_other", F.explode(F.sequence(first_other, F.lit(nr - 1))))
    b = b.withColumn("_other", F.explode(F.sequence(F.lit(0), last_other)))
    a = a.withColumnsRenamed({"_own": "_lb", "_other": "_rb"})
    b = b.withColumnsRenamed({"_own": "_rb", "_other": "_lb"})
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # own column identities when both sides are one frame
    run = _kernel(mode, k, threshold, digits, is_self, drop_self, schema)
    return (
        a.groupBy("_lb", "_rb")
        .cogroup(b.groupBy("_lb", "_rb"))
        .applyInArrow(run, _BIN_SCHEMA if mode == "bins" else _PAIR_SCHEMA)
    )


def _cut(pairs, k):
    w = Window.partitionBy("left_id").orderBy(F.desc("sim"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _short(left, rows):
    """The left side as ids and unit vectors if it has at most so many rows, else None."""
    table = left.select("id", "vec").limit(rows + 1).toArrow()
    return _matrix(table)[:2] if 0 < table.num_rows <= rows else None


def _chunks(batches, width, rows):
    """Ids and unit vectors, some rows at a time; vectors of another length than the left side's are an error there too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            ids, mat, _ = _matrix(pa.Table.from_batches([batch.slice(at, rows)]))
            if mat.shape[1] != width:
                raise ValueError(f"vectors of {mat.shape[1]} and of {width} components")
            yield ids, mat


def _running_best(ids, mat, k, digits, drop_self, rows):
    """For one task: the best k of its right rows per left row, whatever number of rows it reads."""

    def prune(found):
        q, other, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((other, -sim, q))
        q, other, sim = q[order], other[order], sim[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], other[keep], sim[keep]

    def run(batches):
        found, kth = [], np.full(len(ids), -np.inf)
        for other, right in _chunks(batches, mat.shape[1], rows):
            sim = np.round(mat @ right.T, digits)
            allowed = sim >= kth[:, None]
            if drop_self:
                allowed &= ids[:, None] != other[None, :]
            q, c = _best(sim, allowed, k)
            found.append((q, other[c], sim[q, c]))
            if sum(len(f[0]) for f in found) > 4 * k * len(ids):
                found = [prune(found)]
                q, _, sim = found[0]
                full = np.bincount(q, minlength=len(ids)) >= k
                kth[full] = sim[np.searchsorted(q, np.flatnonzero(full), "right") - 1]
        if found:
            q, other, sim = prune(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(other), pa.array(sim)], ["left_id", "right_id", "sim"])

    return run


def _every_score(ids, mat, digits, drop_self, rows):
    def run(batches):
        for other, right in _chunks(batches, mat.shape[1], rows):
            sim = np.round(mat @ right.T, digits)
            q, c = np.nonzero(ids[:, None] != other[None, :]) if drop_self else (a.ravel() for a in np.indices(sim.shape))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(other[c]), pa.array(sim[q, c])], ["left_id", "right_id", "sim"])

    return run


def top_k(left: DataFrame, right: DataFrame, k: int, digits: int = DIGITS, drop_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(left_id, right_id, sim, rank): the k rows of ``right`` nearest to each row of ``left``.

    Up to ``block_rows`` left rows go to the tasks that read ``right``, and at most k rows per left row come
    out of each; more of them meet ``right`` in blocks.
    """
    short = _short(left, block_rows)
    if short is None:
        return _cut(_join(left, right, "top", k=k, digits=digits, drop_self=drop_self, block_rows=block_rows), k)
    best = right.select("id", "vec").mapInArrow(_running_best(*short, k, digits, drop_self, block_rows), _PAIR_SCHEMA)
    return _cut(best, k)


def self_top_k(df: DataFrame, k: int, drop_self: bool = True, **opts) -> DataFrame:
    return _cut(_self_join(df, "top", k=k, drop_self=drop_self, **opts), k)


def pairs_above(df: DataFrame, threshold: float, **opts) -> DataFrame:
    """(left_id < right_id, sim) with sim >= threshold."""
    return _self_join(df, "pairs", threshold=threshold, **opts)


def _best_kernel(threshold, digits, split):
    """Best similarities of two blocks' ids, each pair once. ``split``: only pairs with an id that lies in several blocks, else only the others."""
    def run(key, left, right):
        lid, lmat, _ = _matrix(left)
        rid, rmat, _ = _matrix(right)
        cut = [np.unique(t.filter(t.column("split")).column("id").to_numpy()) for t in (left, right)]
        lcut, rcut = np.isin(lid, cut[0]), np.isin(rid, cut[1])
        if split and not lcut.any() and not rcut.any() or not len(lid) or not len(rid):
            return None
        if split and not rcut.any():
            lid, lmat, lcut = lid[lcut], lmat[lcut], lcut[lcut]
        elif split and not lcut.any():
            rid, rmat, rcut = rid[rcut], rmat[rcut], rcut[rcut]
        rows, cols, sim = _reached(lmat, rmat, threshold, digits)
        keep = (lcut[rows] | rcut[cols]) == split
        keep &= lid[rows] < rid[cols] if key[0] == key[1] else lid[rows] != rid[cols]
        rows, cols, sim = rows[keep], cols[keep], sim[keep]
        first, a = np.unique(lid, return_inverse=True)
        second, b = np.unique(rid, return_inverse=True)
        a, b = a[rows], b[cols]
        if len(first) < len(lid) or len(second) < len(rid):
            pair = a * len(second) + b
            order = np.argsort(pair, kind="stable")
            pair, sim = pair[order], sim[order]
            start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
            sim = np.maximum.reduceat(sim, start) if len(start) else sim
            a, b = pair[start] // len(second), pair[start] % len(second)
        a, b = first[a], second[b]
        return pa.table({"left_id": np.minimum(a, b), "right_id": np.maximum(a, b), "sim": sim}, schema=_arrow_schema("pairs"))

    return run


def best_pairs_above(df: DataFrame, threshold: float, digits: int = DIGITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(left_id < right_id, sim): the largest similarity of the rows of two ids, where it reaches the threshold. An id may have many rows.

    The rows of an id lie in one block, so a task knows the largest and gives each pair once. Only pairs with an id of more rows
    than a block are put together from several tasks.
    """
    sizes = df.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    sizes = cut_lineage(sizes.where("parts > 1"))
    split = not sizes.isEmpty()
    if split:
        df = df.join(sizes, "id", "left").withColumn("split", F.col("parts").isNotNull())
        df = df.withColumn("part", F.coalesce(F.pmod(F.xxhash64("vec"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    else:
        df = df.withColumn("split", F.lit(False)).withColumn("part", F.lit(0).cast("long"))
    n = df.count()
    if n <= block_rows:
        tiles = pivots.plain_tiles(df, 1)
    else:
        tiles = pivots.tiles(df, n, block_rows, threshold=threshold, together=["id", "part"])
    whole = tiles.apply(_best_kernel(threshold, digits, False), _PAIR_SCHEMA)
    if not split:
        return whole
    rest = tiles.apply(_best_kernel(threshold, digits, True), _PAIR_SCHEMA)
    return whole.unionByName(rest.groupBy("left_id", "right_id").agg(F.max("sim").alias("sim")))


def links_above(df: DataFrame, threshold: float, **opts) -> DataFrame:
    """(left_id < right_id): edges that connect the rows that the pairs of ``pairs_above`` connect, but not one per pair.

    A task replaces the pairs it has found by a star per component, so what leaves it is bounded by the rows that it reads.
    """
    return _self_join(df, "pairs", threshold=threshold, combine=_stars, **opts).select("left_id", "right_id")


def pairs_between(left: DataFrame, right: DataFrame, threshold: float, **opts) -> DataFrame:
    """(left_id, right_id, sim) with sim >= threshold, between two frames."""
    return _join(left, right, "pairs", threshold=threshold, **opts)


def score_all(left: DataFrame, right: DataFrame, digits: int = DIGITS, drop_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every left-right similarity: for reports that score a whole population against a short list, which goes to its rows."""
    short = _short(left, block_rows)
    if short is None:
        return _join(left, right, "all", digits=digits, drop_self=drop_self, block_rows=block_rows)
    rows = max(1, (1 << 20) // len(short[0]))
    return right.select("id", "vec").mapInArrow(_every_score(*short, digits, drop_self, rows), _PAIR_SCHEMA)


def best_of_groups(left: DataFrame, right: DataFrame, digits: int = DIGITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(left_id, grp, sim): the largest similarity of each left row with the rows of each group, for every group.

    ``right``: (id, grp, vec). Rows are dealt by group, so that a task sends about one score per left row and group.
    """
    short = _short(left, block_rows)
    if short is None:
        every = score_all(left, right.select("id", "vec"), digits, block_rows=block_rows)
        found = every.join(right.select(F.col("id").alias("right_id"), "grp"), "right_id")
        return found.groupBy("left_id", "grp").agg(F.max("sim").alias("sim"))
    ids, mat = short
    rows = max(1, (1 << 20) // len(ids))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = pa.Table.from_batches([batch.slice(at, rows)])
                _, theirs, groups = _matrix(part)
                by = np.argsort(groups.to_numpy(), kind="stable")
                groups = groups.to_numpy()[by]
                start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
                best = np.maximum.reduceat(np.round(mat @ theirs[by].T, digits), start, axis=1)
                q, g = (a.ravel() for a in np.indices(best.shape))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(groups[start][g]), pa.array(best[q, g])], ["left_id", "grp", "sim"])

    dealt = right.select("id", "grp", "vec").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "left_id long, grp long, sim double").groupBy("left_id", "grp").agg(F.max("sim").alias("sim"))


def pair_bins(df: DataFrame, digits: int = DIGITS, **opts) -> DataFrame:
    """(sim, n): how many unordered pairs have each rounded similarity."""
    bins = _self_join(df, "bins", digits=digits, **opts)
    return bins.groupBy("bin").agg(F.sum("n").alias("n")).select((F.col("bin") / 10**digits).alias("sim"), "n")


def pair_percentiles(df: DataFrame, percents=(50, 90, 95, 99, 99.9), **opts) -> DataFrame:
    """(pct, sim): linearly interpolated percentiles over all unordered pairs."""
    return percentiles_of(pair_bins(df, **opts), percents)


def percentiles_of(bins: DataFrame, percents) -> DataFrame:
    """(pct, sim): linearly interpolated percentiles of values that occur ``n`` times each."""
    points = F.array(*[F.struct(F.lit(float(p)).alias("pct"), F.lit(i).alias("i")) for i, p in enumerate(percents)])
    ps = F.percentile("sim", [float(p) / 100.0 for p in percents], F.col("n"))
    return (
        bins.agg(ps.alias("v"))
        .select(F.explode(points).alias("p"), "v")
        .select(F.col("p.pct").alias("pct"), F.round(F.get("v", F.col("p.i")), 6).alias("sim"))
    )


# ---- approximate search --------------------------------------------------------------------------------------

class Signatures:
    """Where unit vectors point, by several tables of two hashes each.

    A hash turns a vector at random and names the axis it then lies closest to, of at most 64 axes with two directions each. A table's signature is
    the pair of names. Near vectors share a signature in some table; of unrelated ones a pair in thousands does.
    """

    def __init__(self, width: int, tables: int, seed: int):
        rng = np.random.default_rng(seed)
        self.axes = min(width, 64)
        self.turns = [[np.linalg.qr(rng.normal(size=(width, self.axes)))[0] for _ in range(2)] for _ in range(tables)]

    def _sides(self, mat, turn):
        along = mat @ turn
        return np.concatenate([along, -along], axis=1)

    def of(self, mat: np.ndarray) -> np.ndarray:
        """(table, row): each row's own signature."""
        return np.stack([self._sides(mat, a).argmax(axis=1) * 2 * self.axes + self._sides(mat, b).argmax(axis=1) for a, b in self.turns])

    def near(self, mat: np.ndarray, probes: int) -> np.ndarray:
        """(table, row, probe): the signatures that vectors close to a row have most likely, its own first."""
        few = min(2 * self.axes, 12)
        out = []
        for pair in self.turns:
            loss, name = [], []
            for turn in pair:
                sides = self._sides(mat, turn)
                name.append(np.argsort(-sides, axis=1, kind="stable")[:, :few])
                loss.append((sides.max(axis=1, keepdims=True) - np.take_along_axis(sides, name[-1], 1)) ** 2)
            both = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(len(mat), -1)
            best = np.argsort(both, axis=1, kind="stable")[:, :probes]
            out.append(np.take_along_axis(name[0], best // few, 1) * 2 * self.axes + np.take_along_axis(name[1], best % few, 1))
        return np.stack(out)


class SignatureIndex:
    """A stored index and how it was made: a row (tab, sig, id) per table and distinct vector, in the order of (tab, sig),
    under the vector's least id, and `copies` (id, copy) of the vectors that several rows have."""

    def __init__(self, rows: DataFrame, copies: DataFrame, width: int, tables: int, seed: int):
        self.rows, self.copies, self.width, self.tables, self.seed = rows, copies, width, tables, seed


def build_index(df: DataFrame, width: int, tables: int = 32, seed: int = 7, path: str | None = None) -> SignatureIndex:
    """Index of all rows of df (id, vec) with ``width`` components; written to ``path``, or to the shared folder."""

    def run(batches):
        known = Signatures(width, tables, seed)
        for ids, mat in _chunks(batches, width, 1024):
            sig = known.of(mat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(ids))), pa.array(sig.ravel().astype(np.int32)), pa.array(np.tile(ids, tables))],
                ["tab", "sig", "id"])

    # Equal vectors, by two 64-bit hashes, share all signatures; one of them stands for all.
    named = df.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    alike = named.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = cut_lineage(named.join(cut_lineage(alike), ["h1", "h2"]).select(F.col("first").alias("id"), F.col("id").alias("copy")))
    later = copies.where("id <> copy").select(F.col("copy").alias("id"))
    rows = df.select("id", "vec").join(later, "id", "left_anti").mapInArrow(run, "tab int, sig int, id long")
    rows = rows.repartitionByRange("tab", "sig", "id").sortWithinPartitions("tab", "sig", "id")
    if path is None:
        return SignatureIndex(cut_lineage(rows), copies, width, tables, seed)
    read = df.sparkSession.read
    rows.write.parquet(f"{path}/rows")
    copies.write.parquet(f"{path}/copies")
    return SignatureIndex(
        read.schema("tab int, sig int, id long").parquet(f"{path}/rows"), read.schema("id long, copy long").parquet(f"{path}/copies"), width, tables, seed)


def candidate_pairs(left: DataFrame, index: SignatureIndex, probes: int = 14) -> DataFrame:
    """(left_id, right_id), each once: the indexed vectors with one of the signatures probed for a left row."""
    width, tables, seed = index.width, index.tables, index.seed

    def run(batches):
        known = Signatures(width, tables, seed)
        for ids, mat in _chunks(batches, width, 512):
            sig = known.near(mat, probes)
            n, p = sig.shape[1:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(tables, dtype=np.int32), n * p)), pa.array(sig.ravel().astype(np.int32)), pa.array(np.tile(np.repeat(ids, p), tables))],
                ["tab", "sig", "left_id"])

    asked = left.select("id", "vec").mapInArrow(run, "tab int, sig int, left_id long")
    return index.rows.join(asked, ["tab", "sig"]).select("left_id", F.col("id").alias("right_id")).distinct()


def approximate_top_k(left: DataFrame, right: DataFrame, k: int, index: SignatureIndex, probes: int = 14) -> DataFrame:
    """(left_id, right_id, sim, rank) as top_k, of the candidates that ``index`` (of ``right``) names.

    Candidates are scored exactly, with no cut on their number or distance, equal vectors once: of the k best, the k least
    copies of each come in. A left row that has fewer than k of them is searched
    exactly instead, so every left row gets k rows if ``right`` has as many.
    """
    pairs = cut_lineage(candidate_pairs(left, index, probes))
    ours = left.select(F.col("id").alias("left_id"), unit("vec").alias("u"))
    theirs = right.select(F.col("id").alias("right_id"), unit("vec").alias("v"))
    scored = pairs.join(theirs, "right_id").join(ours, "left_id").select("left_id", "right_id", F.round(dot("u", "v"), DIGITS).alias("sim"))
    found, many = _cut(scored, k), F.lit(1)
    if not index.copies.isEmpty():
        best = cut_lineage(found)
        least = Window.partitionBy("id").orderBy("copy")
        mine = index.copies.join(best.select(F.col("right_id").alias("id")).distinct(), "id", "left_semi")
        mine = mine.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k).groupBy("id").agg(F.collect_list("copy").alias("copies"))
        whole = best.join(mine.withColumnRenamed("id", "right_id"), "right_id", "left")
        found = _cut(whole.select("left_id", F.explode(F.coalesce("copies", F.array("right_id"))).alias("right_id"), "sim"), k)
        sizes = index.copies.groupBy(F.col("id").alias("right_id")).agg(F.count(F.lit(1)).alias("n_copies"))
        pairs, many = pairs.join(sizes, "right_id", "left"), F.coalesce("n_copies", F.lit(1))
    enough = pairs.groupBy("left_id").agg(F.sum(many).alias("n")).where(F.col("n") >= k)
    rest = left.join(enough.select(F.col("left_id").alias("id")), "id", "left_anti")
    if rest.isEmpty():
        return found
    exact = top_k(rest, right, k)
    return found.join(enough, "left_id", "left_semi").unionByName(exact)
