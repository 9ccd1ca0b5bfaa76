"""Tables derived from a folder, written once and read by every later query of the session."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowhow.session import shared_folder

_WRITTEN: dict[tuple, tuple] = {}


def version(spark: SparkSession, paths: list[str]) -> int:
    """Changes when a file below the paths is added, removed or written again; lists files and reads none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()[0] or 0


def stored(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], layout: Callable | None = None) -> DataFrame:
    """What ``build`` gives, from the folder that all executors share: written by the first caller with this key.

    ``layout`` may set partitioning on the writer.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _WRITTEN:
        df, path = build(), f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
        writer = df.write
        (layout(writer) if layout else writer).parquet(path)
        _WRITTEN[key] = path, df.schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)
