"""Classes of similar sets: banded signatures propose pairs, estimates thin them out, whole sets decide."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import bitmap, saved
from knowhow.llm.shingles import equal_registers, mix
from knowhow.operators.clusters import connected_components


#: Bits of the map of buckets with several sets (8 MB). Where it fills up more rows are shuffled, with the same result.
BITS = 1 << 26


@dataclass(frozen=True)
class Banding:
    """Signature layout and how to read an estimate from it. `percent`: the similarity asked for."""

    bands: int
    rows: int
    bits: int
    margin: float
    percent: int = 80
    collide: float = 0.0

    def estimate(self, a, b, n_a, n_b):
        """Share of equal registers, less the registers that are equal by chance."""
        chance = self.collide * n_a * n_b / np.square(n_a + n_b)
        return (equal_registers(a, b, self.rows, self.bits) / (self.bands * self.rows) - chance) / (1 - chance)

    def near(self, a, b, n_a, n_b):
        """Whether the estimate leaves the similarity possible, and the sizes do."""
        close = 100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b)
        return close & (self.estimate(a, b, n_a, n_b) >= self.percent / 100 - self.margin)


def _signatures(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _names(bands: int):
    def run(batches):
        for t in batches:
            band = t.column("band").to_numpy()
            name = mix(t.column("key").to_numpy().view(np.uint64) ^ mix(np.arange(bands))[band])
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64))], ["name"])

    return run


def _met(bits):
    """(id, band, key) of those buckets of each set that the map `bits` has."""

    def run(batches):
        known = np.frombuffer(bits.value, np.uint8)
        for t in batches:
            if not t.num_rows:
                continue
            sig = _signatures(t.column("sig"))
            place = mix(sig.view(np.uint64) ^ mix(np.arange(sig.shape[1]))).view(np.int64) & (BITS - 1)
            row, band = np.nonzero((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            yield pa.RecordBatch.from_arrays([t.column("id").take(pa.array(row)), pa.array(band, pa.int32()), pa.array(sig[row, band])], ["id", "band", "key"])

    return run


def _estimated(banding: Banding):
    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            n_a, n_b = (t.column(c).to_numpy().astype(np.float64) for c in ("n", "n_b"))
            e = banding.estimate(_signatures(t.column("sig")), _signatures(t.column("sig_b")), n_a, n_b)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(e)], ["a", "b", "estimate"])

    return run


def _buckets(t: pa.Table):
    """The rows of one bucket (or pair of blocks of one) after another, as arrays by column."""
    key = t.column("part").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    cols = {c: t.column(c).to_numpy()[order] for c in ("id", "component", "band", "block", "other", "part")}
    cols["n"] = t.column("n").to_numpy()[order].astype(np.float64)
    cols["sig"] = _signatures(t.column("sig"))[order]
    cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        yield {k: v[x:y] for k, v in cols.items()}, order[x:y]


def _open(banding: Banding, g: dict, i: int, label: np.ndarray) -> np.ndarray:
    """Later rows of the bucket that row i must be compared with: in another component, possibly similar, and with
    no band before this one in common (a pair that shares several bands is left to the first of them)."""
    rest = np.arange(i + 1, len(label))
    rest = rest[(label[rest] != label[i]) & ((g["block"][rest] != g["block"][i]) | (g["other"][rest] == g["block"][rest]))]
    if len(rest):
        rest = rest[banding.near(g["sig"][i][None, :], g["sig"][rest], g["n"][i], g["n"][rest])]
        rest = rest[(g["sig"][rest] == g["sig"][i]).argmax(axis=1) == g["band"][i]]
    return rest


def _needed(banding: Banding):
    """The rows that have a pair to be compared in their bucket: at most the rows that came in."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        for g, at in _buckets(t):
            wanted = np.zeros(len(at), bool)
            for i in range(len(at)):
                rest = _open(banding, g, i, g["component"])
                wanted[rest] = True
                wanted[i] |= len(rest) > 0
            out.append(at[wanted])
        return t.take(pa.array(np.concatenate(out))).select(["id", "component", "n", "sig", "band", "block", "other", "part"])

    return run


def _linked(banding: Banding, chunk: int = 256):
    """Links between components: per bucket no more than its rows, as a component is joined once.

    Shingles are compared by their first 32 bits here; the caller confirms what comes out on the whole ones.
    """

    def run(t: pa.Table) -> pa.Table:
        tokens = t.column("tokens").combine_chunks()
        values, offset = tokens.flatten().to_numpy().view(np.uint32), np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())])
        a, b = [], []
        for g, at in _buckets(t):
            label = g["component"].copy()
            for i in range(len(at)):
                rest = _open(banding, g, i, label)
                if not len(rest):
                    continue
                mine = values[offset[at[i]] : offset[at[i] + 1]]
                near = banding.estimate(g["sig"][i][None, :], g["sig"][rest], g["n"][i], g["n"][rest])
                rest = rest[np.argsort(-near, kind="stable")]
                while len(rest):
                    now, rest = rest[:chunk], rest[chunk:]
                    sets = [values[offset[at[j]] : offset[at[j] + 1]] for j in now]
                    flat = np.concatenate(sets)
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]]))
                    for j in now[100 * shared >= banding.percent * (g["n"][i] + g["n"][now] - shared)]:
                        if label[i] != label[j]:
                            a.append(min(g["id"][i], g["id"][j]))
                            b.append(max(g["id"][i], g["id"][j]))
                            label[label == label[j]] = label[i]
                    rest = rest[label[rest] != label[i]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets_of(ids: DataFrame, classes: DataFrame, whole_sets: Callable) -> DataFrame:
    asked = saved(classes.join(ids, "id", "left_semi").select("id", "h1", "h2", "place"), "asked")
    sets = whole_sets(asked).join(asked.select("id", "h1", "h2"), ["h1", "h2"]).dropDuplicates(["id"])
    return saved(sets.select("id", "shingles"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - shared
    return saved(both.where(100 * shared >= percent * union).select("a", "b"), "links")


def similar_classes(marks: DataFrame, whole_sets: Callable[[DataFrame], DataFrame], banding: Banding, block: int = 4096) -> DataFrame:
    """(h1, h2, place, members, component, first): one row per distinct set of marks, with its class.

    marks: h1, h2 (the set's name), n (its size, over 0), sig (banded registers), place (any orderable value). `first`
    is the least place of the class. whole_sets(asked) returns (h1, h2, shingles) for rows (h1, h2, place).

    Equal sets are one row from here on, so copies never meet each other. First every set is compared with the
    lowest set of each of its buckets, and linked to the best match: that joins most of a large group by one link
    per member. Then only pairs that share a bucket and are still in different components are left; all of them are
    estimated, large buckets in pairs of blocks of about `block` rows that run as tasks of their own. The sets of
    rows that may be similar to another are sent to their buckets and compared there, so that only links come out,
    no more than rows went in. No pair that shares a bucket is left out; what comes out is confirmed again on the
    whole sets.
    """
    classes = marks.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = classes.select("id", F.posexplode("sig").alias("band", "key"))
    buckets = saved(rows.groupBy("band", "key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
    # From here on only sets that share a bucket with another take part, and only with those buckets. A map of them goes
    # to all tasks, so that few other rows are shuffled.
    names = buckets.select("band", "key").mapInArrow(_names(banding.bands), "name long")
    bits = marks.sparkSession.sparkContext.broadcast(bitmap(names, BITS))
    rows = classes.select("id", "sig").mapInArrow(_met(bits), "id long, band int, key long")
    members = saved(rows.join(buckets, ["band", "key"]), "members")
    active = saved(classes.select("id", "n", "sig").join(members.select("id").distinct(), "id", "left_semi"), "active")
    # Every member of a large bucket meets the same lowest set, which therefore goes to as many tasks as those need.
    salts = F.ceil(F.max("rows") / (block // 4))
    stars = members.where("id <> low").groupBy(F.col("id").alias("a"), F.col("low").alias("b")).agg(salts.alias("salts"))
    stars = stars.select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    lows = buckets.groupBy(F.col("low").alias("b")).agg(salts.alias("salts")).join(active.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    lows = lows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    stars = stars.join(active.withColumnRenamed("id", "a"), "a").join(lows, ["b", "salt"])
    stars = stars.where(100 * F.least("n", "n_b") >= banding.percent * F.greatest("n", "n_b"))
    scored = stars.mapInArrow(_estimated(banding), "a long, b long, estimate double").where(F.col("estimate") >= banding.percent / 100 - banding.margin)
    best = saved(scored.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "best")
    sets = _sets_of(best.select(F.col("a").alias("id")).union(best.select(F.col("b").alias("id"))).distinct(), classes, whole_sets)
    links = _confirmed(best, sets, banding.percent)
    joined = saved(connected_components(links), "joined").select(F.col("node").alias("id"), "component")

    labelled = active.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = members.select("id", "band", "key")
    mixed = spread.join(labelled.select("id", "component"), "id").groupBy("band", "key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y")
    mixed = saved(mixed.select("band", "key", F.ceil(F.col("rows") / block).alias("blocks"), "rows"), "mixed")
    tasks = mixed.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0]
    if tasks:
        dealt = spread.join(mixed, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        part = F.xxhash64("band", "key", F.least("block", "other"), F.greatest("block", "other"))
        dealt = dealt.select("id", "band", "block", "other", part.alias("part")).join(labelled.select("id", "component", "n", "sig"), "id")
        # A slot holds whole buckets, together about 20,000 rows; the second time, with sets, about 2,000.
        layout = "id long, component long, n long, sig array<long>, band int, block long, other long, part long"
        dealt = dealt.withColumn("slot", F.pmod("part", F.lit(max(1, tasks // 20_000))))
        needed = saved(dealt.groupBy("slot").applyInArrow(_needed(banding), layout), "needed")
        # Texts are fetched once: most of these sets are there already.
        missing = needed.select("id").distinct().join(sets, "id", "left_anti")
        sets = sets.union(_sets_of(missing, classes, whole_sets))
        tokens = sets.select("id", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("tokens"))
        full = needed.join(tokens, "id").withColumn("slot", F.pmod("part", F.lit(max(1, needed.count() // 2_000))))
        pairs = saved(full.groupBy("slot").applyInArrow(_linked(banding), "a long, b long").distinct(), "pairs")
        if not pairs.isEmpty():
            more = _confirmed(pairs, sets, banding.percent)
            joined = saved(connected_components(links.unionByName(more)), "joined").select(F.col("node").alias("id"), "component")
    out = classes.drop("sig").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = saved(out, "components")
    firsts = out.groupBy("component").agg(F.min("place").alias("first"), F.sum("members").alias("rows"))
    return out.join(firsts, "component").select("h1", "h2", "place", "members", "component", "first", "rows")
