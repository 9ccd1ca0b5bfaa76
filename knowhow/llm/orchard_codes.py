"""Vector codes: parts of vectors are replaced by their nearest codebook entry, found by Orchard's search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import saved, with_totals
from knowhow.llm.grids import STEPS, SUMS, Sums, largest, least_rows, moved, on_grid, plain_vectors

BLOCK = 2048


class Orchard:
    """For every entry of every codebook, the codebook's entries in the order of distance from it."""

    def __init__(self, books: np.ndarray):
        self.parts, self.entries, self.width = books.shape
        self.flat = books.reshape(-1, self.width)
        gap = np.empty((self.parts, self.entries, self.entries), np.int64)
        for e in range(self.entries):
            gap[:, e] = ((books - books[:, e : e + 1]) ** 2).sum(axis=2)
        order = np.argsort(gap, axis=2, kind="stable")
        self.order = order.reshape(-1, self.entries)
        ends = np.full((len(self.flat), 1), np.iinfo(np.int64).max)  # a list's end counts as beyond all
        self.gap = np.concatenate([np.take_along_axis(gap, order, 2).reshape(-1, self.entries), ends], axis=1)
        #: Entries by their first component: where a search starts.
        self.by_first = np.argsort(books[:, :, 0], axis=1, kind="stable")
        self.first = np.take_along_axis(books[:, :, 0], self.by_first, 1)

    def search(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) arrays: nearest entry (ties to the lower index) and squared distance.

        All searches go on side by side, one list position at a time. A search walks the list of its best entry so
        far; an entry that is nearer takes over and its list is walked from the start; entries met before are
        skipped. Beyond twice the best distance no entry can be nearer or as near.
        """
        n = len(cells)
        part = cells.reshape(n * self.parts, self.width)
        base = np.tile(np.arange(self.parts) * self.entries, n)
        start = np.empty((n, self.parts), np.int64)
        for p in range(self.parts):
            at = np.searchsorted(self.first[p], cells[:, p * self.width])
            start[:, p] = self.by_first[p, np.minimum(at, self.entries - 1)]
        best = base + start.ravel()
        near = ((part - self.flat[best]) ** 2).sum(axis=1)
        met = np.zeros((len(part), self.entries), bool)
        met[np.arange(len(part)), best - base] = True
        place, live = np.zeros(len(part), np.int64), np.arange(len(part))
        while len(live):
            live = live[self.gap[best[live], place[live]] <= 4 * near[live]]
            other = self.order[best[live], place[live]]
            place[live] += 1
            new = ~met[live, other]
            row, other = live[new], other[new]
            met[row, other] = True
            entry = base[row] + other
            d = ((part[row] - self.flat[entry]) ** 2).sum(axis=1)
            better = (d < near[row]) | ((d == near[row]) & (entry < best[row]))
            row = row[better]
            best[row], near[row], place[row] = entry[better], d[better], 0
        return (best - base).reshape(n, self.parts), near.reshape(n, self.parts)


def _blocks(batches, width: int, most: int):
    for batch in batches:
        at, cells = on_grid(batch.column("v"), width, most)
        for k in range(0, len(at), BLOCK):
            yield batch, at[k : k + BLOCK], cells[k : k + BLOCK]


def _sums(books: np.ndarray, most: int):
    def run(batches):
        tree, parts, entries, width = Orchard(books), *books.shape
        sums = Sums(parts * entries, width)
        for _, at, cells in _blocks(batches, parts * width, most):
            entry, _ = tree.search(cells)
            sums.add((entry + np.arange(parts) * entries).ravel(), cells.reshape(-1, width))
        yield sums.batch()

    return run


def _codes(books: np.ndarray, most: int):
    def run(batches):
        tree, parts, _, width = Orchard(books), *books.shape
        for batch, at, cells in _blocks(batches, parts * width, most):
            entry, d = tree.search(cells)
            code = [r.tobytes().hex() for r in entry.astype(np.uint8)]
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(rows), batch.column("label").take(rows), pa.array(code, pa.string()), pa.array(d.sum(axis=1))],
                ["vec_id", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Entries (part, entry, component) on the grid of 1/256; None without a usable vector. See vector_codes.

    A round is one scan: each task adds up its vectors by entry, the sums of all tasks are added by Spark, and
    the codebooks, which do not grow with the rows, go back to the tasks.
    """
    v = plain_vectors(vectors)
    fits = (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) * STEPS < float(largest(1))))
    one = vectors.where(fits).select("vec_id", F.size(v).alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").limit(1).collect()
    if not one:
        return None
    size = one[0].n
    width, most = size // parts, largest(size // parts)
    rows = vectors.select(F.col("vec_id").alias("key"), v.alias("v"))
    first = least_rows(rows, entries, size, most)
    if not len(first):
        return None
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        partial = rows.select("v").mapInArrow(_sums(books, most), SUMS)
        books = moved(books.reshape(-1, width), partial).reshape(books.shape)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, books: np.ndarray | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of vectors (vec_id, embedding, label).

    Components become floor(256 * x). Each of `parts` equal parts of a vector has a codebook, which starts as that
    part of the vectors with the least vec_id (null ids last, equal ids in the order of their vectors; fewer
    vectors than `entries` make a shorter codebook) and moves `rounds` times to the floor of its parts' means. code
    has two hex digits per part; at most 256 entries. error is the squared distance on the grid, label_error its sum over the rows
    with the same label, nulls together. Given `books` are used as they are.

    Vectors that are null, empty, or hold null or non-finite components are left out; so are those whose length is not
    that of the first usable vector by vec_id, and those with a component beyond largest(): 2**20 for 64 components in 16
    parts. Repeated rows give a row each. No usable vector gives an empty table. Other columns are ignored.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    if books is None:
        books = codebooks(vectors, parts, entries, rounds)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    out = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    rows = vectors.select("vec_id", "label", plain_vectors(vectors).alias("v"))
    coded = saved(rows.mapInArrow(_codes(books, largest(books.shape[2])), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    return with_totals(coded, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(books_digest(books))).select(*out)


def decoded_vectors(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, embedding: the vectors that codes (vec_id, code) stand for, the middle of each grid cell. A null code gives null."""
    parts = books.shape[0]

    def run(batches):
        for batch in batches:
            index = [None if c is None else np.frombuffer(bytes.fromhex(c), np.uint8) for c in batch.column("code").to_pylist()]
            out = [None if i is None else ((books[np.arange(parts), i].ravel() + 0.5) / STEPS).tolist() for i in index]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    kind = codes.schema["vec_id"].dataType.simpleString()
    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {kind}, embedding array<double>")
