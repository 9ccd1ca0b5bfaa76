"""Pairs of blocks of rows, without a copy of a row per pair.

A block is one row of a table that is written once: its keys, and its rows as Arrow bytes. Pairs come from the product of that
table with itself, whose tasks read the files of both sides where they lie. So what is shuffled and stored grows with the rows; only reads and
multiplications grow with the pairs. A task sees one pair at a time, whatever the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.session import written

#: Rows that a task keeps before it combines them.
MOST_KEPT = 1 << 21


def closed(table: pa.Table, codec: str | None = None) -> bytes:
    """What ``opened`` reads."""
    sink, table = pa.BufferOutputStream(), table.combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def packed(rows: DataFrame, keys: list[str], n_blocks: int | None = None, codec: str | None = None) -> DataFrame:
    """(*keys, rows): a written row per block, dealt over as many files as there are cores."""
    names = [c for c in rows.columns if c not in keys]
    files = rows.sparkSession.sparkContext.defaultParallelism
    files = files if n_blocks is None else max(1, min(files, n_blocks))

    def pack(key, table):
        data = {k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=True)}
        return pa.table(data | {"rows": pa.array([closed(table.select(names), codec)], pa.binary())})

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", rows binary"
    return written(rows.repartition(files, *keys).groupBy(*keys).applyInArrow(pack, schema))


def opened(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _run(kernel, combine, one_table=True, most=MOST_KEPT):
    def run(batches):
        kept, size, limit, last, left = [], 0, most, None, None
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("l_rows", "r_rows")]
            for i in range(batch.num_rows):
                key = {c: batch.column(c)[i].as_py() for c in names}
                mine = tuple(v for c, v in key.items() if c.startswith("l_"))
                if mine != last:
                    last, left = mine, opened(batch.column("l_rows")[i])
                same = one_table and mine == tuple(v for c, v in key.items() if c.startswith("r_"))
                right = left if same else opened(batch.column("r_rows")[i])
                found = kernel(key, left, right)
                if found is None or not len(found):
                    continue
                if combine is None:
                    yield from found.to_batches(max_chunksize=1 << 16)
                    continue
                kept.append(found)
                size += len(found)
                if size > limit:
                    kept = [combine(pa.concat_tables(kept))]
                    size = len(kept[0])
                    limit = max(most, 2 * size)
        if kept:
            yield from combine(pa.concat_tables(kept)).to_batches(max_chunksize=1 << 16)

    return run


def pair_up(blocks: DataFrame, condition: str, kernel: Callable, schema: str, combine: Callable | None = None,
            other: DataFrame | None = None, most: int = MOST_KEPT) -> DataFrame:
    """``kernel(key, left, right)`` for every pair of blocks that meets the condition on ``l_...`` and ``r_...`` keys.

    ``key`` holds the values of those keys. ``combine`` shrinks what a task has found so far to the same columns, when it
    is more than ``most`` rows and twice what was left the last time. The right blocks are those of ``other`` where it is given.
    """
    right = blocks if other is None else other
    a = blocks.select(*[F.col(c).alias(f"l_{c}") for c in blocks.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return a.hint("shuffle_replicate_nl").join(b, F.expr(condition)).mapInArrow(_run(kernel, combine, other is None, most), schema)


def each(blocks: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(key, rows)`` for every block; ``key`` holds the values of its keys."""
    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c != "rows"]
            for i in range(batch.num_rows):
                yield from kernel({c: batch.column(c)[i].as_py() for c in names}, opened(batch.column("rows")[i])).to_batches()

    return blocks.mapInArrow(run, schema)
