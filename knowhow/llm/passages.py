"""Repeated passages: runs of words that stand word for word in two or more places, wherever lines end."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow.llm.common import bitmap, deleted, saved, with_values
from knowhow.llm.shingles import _powers, mix, words_of

#: Bits of the map of repeated anchors (8 MB). Where it fills up more windows are compared, with the same result.
BITS = 1 << 26

#: Windows of a slot, and windows of an anchor up to which its segments are compared in one task.
SLOT, TOGETHER = 50_000, 1 << 16


def _rolling(word: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every k words in a row, read off one running sum."""
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(word))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word ^ np.uint64(seed)) * power)])
        return mix((total[k:] - total[:-k]) * inverse[: len(word) - k + 1])


def _spans(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to before its end."""
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(word))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word ^ np.uint64(13)) * power)])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _sliding(f, x: np.ndarray, size: int) -> np.ndarray:
    """f over every `size` neighbours."""
    out, have = x, 1
    while 2 * have <= size:
        out, have = f(out[:-have], out[have:]), 2 * have
    n = len(x) - size + 1
    return f(out[:n], out[size - have : size - have + n])


def _anchored(bodies: list[bytes], length: int):
    """(words, their texts, whether the window of `length` words that starts here lies in one text, hashes of half
    windows, least of the half windows inside each window), or None where no window fits.

    The least half window depends on the window's words alone, so equal windows have the same.
    """
    word, owner = words_of(bodies)
    if len(word) < length:
        return None
    half = (length + 1) // 2
    halves = _rolling(word, half, 11)
    least = _sliding(np.minimum, halves, length - half + 1)
    return word, owner, owner[: len(least)] == owner[length - 1 :], halves, least


def _bodies(batch, size: int = 256):
    for at in range(0, batch.num_rows, size):
        t = batch.slice(at, size)
        yield t, [(x or "").encode("utf-8", "surrogatepass").lower() for x in t.column("text").to_pylist()]


def _anchors(length: int):
    """(anchor, n): half windows that are least in a window, with the places they stand in."""
    width = length - (length + 1) // 2 + 1

    def run(batches):
        for batch in batches:
            for _, bodies in _bodies(batch):
                found = _anchored(bodies, length)
                if found is None:
                    continue
                *_, whole, halves, least = found
                pad = np.zeros(width - 1, np.uint64)
                most = _sliding(np.maximum, np.concatenate([pad, np.where(whole, least, np.uint64(0)), pad]), width)
                value, n = np.unique(halves[(halves == most) & (most > 0)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def _edges(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in characters, and the number of its line (lines without characters not counted)."""
    a = np.frombuffer(body, np.uint8)
    edge = np.diff(np.concatenate([[True], (a == 32) | ((a >= 9) & (a <= 13)), [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    chars = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
    newline = a == 10
    line = np.cumsum(~newline & np.concatenate([[True], newline[:-1]])) - 1
    return chars[start], chars[end], line[start]


def _segments(length: int, bits, most: int = 1024):
    """Stretches of windows that share a repeated anchor, and few others: one row each, at most `most` windows long.

    `segment` hashes all words of the stretch, `windows` each window; `starts`, `ends` and `lines` say where its windows
    lie, counted from `start` and `paragraph`.
    """

    def run(batches):
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for t, bodies in _bodies(batch):
                found = _anchored(bodies, length)
                if found is None:
                    continue
                word, owner, whole, _, least = found
                place = (least & np.uint64(BITS - 1)).astype(np.int64)
                at = np.flatnonzero(whole & ((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool))
                if not len(at):
                    continue
                text = owner[at]
                pos = at - np.searchsorted(owner, text)
                start, end, line, name = (np.empty(len(at), np.int64) for _ in range(4))
                cut = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(at)]])
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    body = bodies[text[x]]
                    first, last, lines = _edges(body)
                    start[x:y], end[x:y], line[x:y] = first[pos[x:y]], last[pos[x:y] + length - 1], lines[pos[x:y]]
                    name[x:y] = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
                new = np.concatenate([[True], (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])])
                head = np.flatnonzero(new)
                since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                head = np.flatnonzero(since % most == 0)
                size = np.diff(np.append(head, len(at)))
                window = _rolling(word, length, 12)[at]
                bounds = pa.array(np.append(head, len(at)).astype(np.int32))

                def lists(values, kind, bounds=bounds):
                    return pa.ListArray.from_arrays(bounds, pa.array(values, kind))

                t = pa.RecordBatch.from_arrays(
                    [pa.array(least[at[head]].view(np.int64)), pa.array(_spans(word, at[head], at[head] + size + length - 1).view(np.int64)),
                     t.column("doc_id").take(pa.array(text[head])), *(pa.array(v[head]) for v in (name, pos)), pa.array(line[head], pa.int32()), pa.array(start[head]),
                     lists(window.view(np.int64), pa.int64()), *(lists(v - np.repeat(w[head], size), pa.int32()) for v, w in ((start, start), (end, start), (line, line)))],
                    ["anchor", "segment", "doc_id", "name", "pos", "paragraph", "start", "windows", "starts", "ends", "lines"])
                yield from (t.slice(x, 4096) for x in range(0, t.num_rows, 4096))

    return run


def repeated_passages(docs: DataFrame, least_run: int = 51) -> DataFrame:
    """One row per maximal run of repeated words: doc_id, paragraph, start, end, words, keep_doc_id, keep_paragraph,
    occurrences, removed.

    Words are separated by ASCII white space and compared with A-Z lower-cased. A window of least_run words is
    repeated when the same words stand in two or more places, in one text or several; its first place (least doc_id,
    then position; null doc_ids rank first) stays. Windows that follow each other and whose first places do so too
    form one run; where the first place changes to another document or distance, a new run begins, and the two may
    overlap. No repeated window is left out. start and end count characters of the text, paragraph is the line the run
    begins in, occurrences is that of its most frequent window. Equal rows give one row. Words of a removed run that
    also lie in a run that is not removed belong to a first place: leave them to keep every passage once.

    Equal windows have the same least half window (their anchor). Anchors are counted first. Neighbouring windows with
    one anchor that occurs twice form a segment, one row; such segments lie alike in equal passages, wherever lines end. Equal
    segments are one row from here on. Segments of one anchor are compared in one task, window by window, each with its
    count; where they are too many for one task, every window is a row. What was found goes back to all places of a
    segment, and pieces that continue each other become runs. The work is linear in the text also for large groups,
    and frequent segments and windows are joined without a shuffle by their key.
    """
    texts = docs.select("doc_id", "text")
    spark = docs.sparkSession
    anchors = texts.mapInArrow(_anchors(least_run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(bitmap(anchors.select("anchor"), BITS))
    layout = "anchor long, segment long, doc_id long, name long, pos long, paragraph int, start long, windows array<long>, starts array<int>, ends array<int>, lines array<int>"
    places = saved(texts.mapInArrow(_segments(least_run, bits), layout).withColumn("key", F.struct("anchor", "segment")).drop("anchor", "segment"), "segments")
    pieces = _pieces(places.select("key", "windows", "lines", F.struct("doc_id", "pos", "paragraph").alias("place")))
    met = with_values(places.drop("windows"), pieces, "key", "rows").select("*", F.explode("pieces").alias("p"))
    first_at, last_at = F.col("p.at") + 1, F.col("p.at") + F.col("p.size")
    met = met.select(
        "doc_id", "name", (F.col("pos") + F.col("p.at")).alias("pos"), (F.col("pos") + last_at).alias("until"),
        (F.col("paragraph") + F.element_at("lines", first_at)).alias("paragraph"), (F.col("start") + F.element_at("starts", first_at)).alias("start"),
        (F.col("start") + F.element_at("ends", last_at)).alias("end"), F.col("p.n").alias("n"), F.col("p.keep_doc_id").alias("keep_doc_id"),
        F.col("p.keep_paragraph").alias("keep_paragraph"), (F.col("pos") - F.col("p.keep_shift")).alias("shift"))
    run = ["doc_id", "name", "keep_doc_id", "shift"]
    # Pieces of one run follow each other without a gap; those of equal rows lie on one another.
    by_pos = Window.partitionBy(*run).orderBy("pos")
    met = met.withColumn("gap", F.coalesce((F.col("pos") > F.lag("until").over(by_pos)).cast("int"), F.lit(0)))
    met = met.withColumn("run", F.sum("gap").over(by_pos))
    runs = met.groupBy(*run, "run").agg(
        F.min("paragraph").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("until") - F.min("pos") + least_run - 1).alias("words"), F.min("keep_paragraph").alias("keep_paragraph"), F.max("n").alias("occurrences"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("shift") == 0)
    return runs.select("doc_id", "paragraph", "start", "end", "words", "keep_doc_id", "keep_paragraph", "occurrences", (~first).alias("removed"))


def _compared(t: pa.Table) -> pa.Table:
    """(key, rows, pieces) as of _pieces(), of all segments of some anchors."""
    lists = t.column("windows").combine_chunks()
    size, window = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    head = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) - head[owner]
    anchor, rows, pos, paragraph = (t.column(c).to_numpy()[owner] for c in ("anchor", "rows", "pos", "paragraph"))
    pos, paragraph = pos + at, paragraph + t.column("lines").combine_chunks().flatten().to_numpy()
    known, doc = (c.to_numpy()[owner] for c in (t.column("doc_id").is_valid(), t.column("doc_id").fill_null(0)))
    # Equal windows side by side, the first place in front.
    order = np.lexsort((paragraph, pos, doc, known, window, anchor))
    new = np.append(True, (np.diff(window[order]) != 0) | (np.diff(anchor[order]) != 0))
    first, group = order[new], np.cumsum(new) - 1
    n, front = (np.empty(len(owner), np.int64) for _ in range(2))
    n[order], front[order] = np.add.reduceat(rows[order], np.flatnonzero(new))[group], first[group]
    found = np.flatnonzero(n > 1)
    if not len(found):
        return PIECES.empty_table()
    n, front, owner, at = n[found], front[found], owner[found], at[found]
    known, doc, shift, paragraph = known[front], doc[front], pos[front] - at, paragraph[front]
    cut = (np.diff(found) != 1) | (np.diff(owner) != 0) | (known[1:] != known[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(shift) != 0)
    cut = np.flatnonzero(np.append(True, cut))
    pieces = pa.StructArray.from_arrays(
        [pa.array(at[cut], pa.int32()), pa.array(np.diff(np.append(cut, len(found))), pa.int32()), pa.array(np.maximum.reduceat(n, cut)),
         pa.array(doc[cut], mask=~known[cut]), pa.array(shift[cut]), pa.array(np.minimum.reduceat(paragraph, cut), pa.int32())],
        fields=list(PIECE))
    head = np.flatnonzero(np.append(True, np.diff(owner[cut]) != 0))
    some = t.select(["anchor", "segment", "rows"]).take(pa.array(owner[cut][head])).combine_chunks()
    bounds = pa.array(np.append(head, len(cut)).astype(np.int32))
    return pa.table([*some.columns, pa.ListArray.from_arrays(bounds, pieces)], names=PIECES.names)


PIECE = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("n", pa.int64()), ("keep_doc_id", pa.int64()), ("keep_shift", pa.int64()), ("keep_paragraph", pa.int32())])
PIECES = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("rows", pa.int64()), ("pieces", pa.list_(PIECE))])


def _pieces(places: DataFrame) -> DataFrame:
    """(key, rows, pieces) of the segments with repeated windows: stretches (at, size) whose first places (keep_doc_id,
    keep_shift: position less that of the segment's first window; keep_paragraph) follow each other."""
    kinds = places.groupBy("key").agg(
        F.min(F.struct("place", "lines")).alias("first"), F.count(F.lit(1)).alias("rows"), F.first("windows").alias("windows"))
    kinds = saved(kinds, "segment-kinds")
    anchors = kinds.groupBy("key.anchor").agg(F.count(F.lit(1)).alias("n_kinds"), F.sum(F.size("windows")).alias("n_windows"))
    anchors = saved(anchors, "anchors")
    slots = max(1, (anchors.agg(F.sum("n_windows")).first()[0] or 0) // SLOT)
    # One anchor at most in as many windows as TOGETHER says, so few that all tasks get them.
    large = F.broadcast(anchors.where(F.col("n_windows") > TOGETHER).select("anchor"))
    rest = kinds.join(large, F.col("key.anchor") == F.col("anchor"), "left_anti")
    rest = rest.select("key.anchor", "key.segment", "rows", "first.place.doc_id", "first.place.pos", "first.place.paragraph", "first.lines", "windows")
    layout = "anchor long, segment long, rows long, pieces array<struct<at: int, size: int, n: long, keep_doc_id: long, keep_shift: long, keep_paragraph: int>>"
    rest = rest.withColumn("slot", F.pmod(F.xxhash64("anchor"), F.lit(slots))).groupBy("slot").applyInArrow(_compared, layout)
    rest = rest.select(F.struct("anchor", "segment").alias("key"), "rows", "pieces")

    told = kinds.join(large, F.col("key.anchor") == F.col("anchor"), "left_semi")
    place = F.struct(F.col("first.place.doc_id").alias("doc_id"), (F.col("first.place.pos") + F.col("at")).alias("pos"),
                     (F.col("first.place.paragraph") + F.get(F.col("first.lines"), F.col("at"))).alias("paragraph"))
    single = saved(told.select("key", "rows", "first", F.posexplode("windows").alias("at", "h")).select(
        "key", "rows", "at", F.struct("key.anchor", "h").alias("window"), place.alias("place")), "windows")
    firsts = single.groupBy("window").agg(F.min("place").alias("first"), F.sum("rows").alias("n"), F.count(F.lit(1)).alias("windows")).where("n > 1")
    firsts = saved(firsts, "repeated-windows")
    same = with_values(single.drop("place"), firsts, "window", "windows").select(
        "key", "rows", "at", "n", F.col("first.doc_id").alias("keep_doc_id"), (F.col("first.pos") - F.col("at")).alias("keep_shift"), F.col("first.paragraph").alias("keep_paragraph"))
    stretch = ["key", "keep_doc_id", "keep_shift"]
    same = same.repartition("key").withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*stretch).orderBy("at")))
    some = same.groupBy(*stretch, "rows", "run").agg(
        F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("size"), F.max("n").alias("n"), F.min("keep_paragraph").alias("keep_paragraph"))
    parts = some.groupBy("key", "rows").agg(F.collect_list(F.struct("at", "size", "n", "keep_doc_id", "keep_shift", "keep_paragraph")).alias("pieces"))
    pieces = saved(rest.unionByName(parts), "pieces")
    deleted(kinds, anchors, single, firsts)
    return pieces
