"""Sharding by a minimax contiguous partition of groups of equal texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import positions, saved


class _Runs:
    """The ordered groups as runs: a digest prefix, the bytes of its groups, and whether it holds one group only.

    Few enough for the driver; finer runs replace those in which a cut may fall.
    """

    def __init__(self, runs: dict[str, tuple[int, int]]):
        self.runs = runs
        self.names = sorted(runs)
        self.ends = np.cumsum([runs[n][0] for n in self.names], dtype=np.int64)
        self.single = np.array([runs[n][1] == 1 for n in self.names])
        self.total = int(self.ends[-1])

    def start(self, i: int) -> int:
        return int(self.ends[i - 1]) if i else 0

    def ends_of(self, capacity: int, shards: int, surely: bool) -> list[int]:
        """Where greedy shards end, surely: at the ends of whole runs only; else: at the furthest a cut inside a run could be."""
        at, out = 0, []
        for _ in range(shards):
            i = int(np.searchsorted(self.ends, at + capacity, "right"))
            if i >= len(self.ends):
                at = self.total
            else:
                at = max(at, self.start(i)) if surely or self.single[i] else at + capacity
            out.append(at)
        return out

    def smallest(self, low: int, shards: int, surely: bool) -> int:
        high = self.total
        while low < high:
            mid = (low + high) // 2
            if self.ends_of(mid, shards, surely)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[str]:
        """Runs of several groups in which a cut may fall, for some capacity from low to high."""
        out = set()
        for a, b in zip(self.ends_of(low, shards, True), self.ends_of(high, shards, False), strict=True):
            i, j = (int(np.searchsorted(self.ends, x, "right")) for x in (a, b))
            out.update(n for n, one in zip(self.names[i : j + 1], self.single[i : j + 1], strict=True) if not one)
        return sorted(out)

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """First prefix of each shard but the first. A shard takes about its share of what is left, as far as the
        capacity and that of the shards after it allow, so that none is left over full or empty without need."""
        least, at = [], self.total
        for _ in range(shards - 1):  # from the right: where a shard must end at the latest for the rest to fit
            i = int(np.searchsorted(np.concatenate([[0], self.ends]), at - capacity, "left"))
            at = self.start(i) if i else 0
            least.append(at)
        out, at = [], 0
        for k, need in zip(range(shards - 1), reversed(least), strict=True):
            i = int(np.searchsorted(self.ends, at + capacity, "right"))
            most = self.total if i >= len(self.ends) else max(at, self.start(i))
            want = at + (self.total - at) / (shards - k)
            j = int(np.searchsorted(self.ends, want, "left"))
            ends = [self.start(j), int(self.ends[min(j, len(self.ends) - 1)])]
            near = min(ends, key=lambda x: abs(x - want))
            at = min(max(near, need, at), most)
            i = int(np.searchsorted(self.ends, at, "right"))
            if i < len(self.names):
                out.append(self.names[i])
            else:
                out.append("g")  # after every hexadecimal digest: an empty shard
        return out


def minimax_cuts(groups: DataFrame, shards: int = 8, digits: int = 4) -> tuple[int, list[str]]:
    """The smallest capacity with which greedy filling needs no more than `shards` shards, and the digests to cut at.

    groups: digest (hexadecimal), bytes. The search runs on sums over digest prefixes, at most 16**digits of them.
    Where a cut may fall inside a prefix, that prefix is split by two more digits in one job, until every run that
    matters is a single group and the smallest capacity is exact.
    """
    def sums(df, n):
        rows = df.groupBy(F.substring("digest", 1, n).alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        return {r["p"]: (int(r["b"]), int(r["n"])) for r in rows.collect()}

    runs = sums(groups, digits)
    if not runs:
        return 0, ["g"] * (shards - 1)
    largest = int(groups.agg(F.max("bytes")).first()[0])
    while True:
        now = _Runs(runs)
        least = max(largest, -(-now.total // shards))
        low, high = now.smallest(least, shards, False), now.smallest(least, shards, True)
        split = now.unsure(low, high, shards) if low < high else []
        if not split:
            return high, now.cuts(high, shards)
        for n in {len(x) for x in split}:
            mine = [x for x in split if len(x) == n]
            finer = sums(groups.where(F.substring("digest", 1, n).isin(mine)), n + 2)
            runs = {k: v for k, v in runs.items() if k not in set(mine)} | finer


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text).

    Equal texts are one atomic group; groups are ordered by their text's digest and cut into contiguous shards of the
    smallest possible capacity, so a row's shard follows from its digest and a few cuts, without a join. size is the
    text's UTF-8 bytes plus 1; a null text counts as an empty one. Repeated rows each get a slot. An empty table gives
    an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest")), "shard-rows")
    groups = saved(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = minimax_cuts(groups, shards)
    shard = sum(((F.col("digest") >= c).cast("int") for c in cuts), F.lit(0))
    placed = positions(rows.withColumn("shard", shard), ["shard"], ["digest", "doc_id"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
