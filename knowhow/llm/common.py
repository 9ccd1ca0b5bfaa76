"""Helpers that several of these operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowhow.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the folder that all executors share: a lost executor costs no
    recomputation of what led to them, and several readers do the work once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Removes the files of saved() tables; only for those that nothing still to be computed reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def saved_in_buckets(df: DataFrame, key: str, name: str) -> DataFrame:
    """As saved(), with as many buckets by key as shuffles have partitions: a join by that key leaves these rows in place.

    The session's catalog gets a temporary name for the table, which lies in the shared folder too.
    """
    spark = df.sparkSession
    label = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{label}").option("compression", "zstd").saveAsTable(label)
    return spark.table(label)


def ascii_lower(text: Column) -> Column:
    """A-Z only; a text without multi-byte characters takes the quick way to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def positions(df: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of each row within its key, nulls last, also when one key holds most rows.

    Rows are range-partitioned by key and order, so a hot key spreads over many tasks; a row's position is its place
    in its partition plus the rows of its key in the partitions before. Repeated rows take neighbouring positions.
    """
    by = [F.col(c).asc_nulls_last() for c in [*within, *order]]
    ranged = saved(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy("_part", *within).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    placed = ranged.withColumn("_local", F.row_number().over(local) - 1)
    same = placed["_part"] == starts["_part"]
    for c in within:
        same = same & placed[c].eqNullSafe(starts[c])
    return placed.join(starts, same).select(*[placed[c] for c in df.columns], (F.col("_start") + F.col("_local")).alias(name))


def take_rows(docs: DataFrame, key: Column, keep: DataFrame, copies: str | None = None) -> DataFrame:
    """The rows of docs whose key is in keep (its first column, without repeats), each once, or `copies` times.

    Rows that share a key are interchangeable and count as one. The join's partitioning and order serve the removal
    of repeats too, so texts are shuffled once.
    """
    mine = docs.withColumn("__key", key).join(keep.withColumnRenamed(keep.columns[0], "__key"), "__key", "inner")
    one = mine.dropDuplicates(["__key"])
    if copies:
        one = one.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return one.select(*[one[c] for c in docs.columns])


def row_key(docs: DataFrame) -> Column:
    """Names a row by doc_id and text, for finding it again."""
    return F.concat_ws("|", docs["doc_id"].cast("string"), F.sha2(docs["text"].cast("binary"), 256))


def thinned(docs: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows of docs whose key is in wanted (its first column; null counts as a key), and few others.

    A bitmap of hashed keys goes to all tasks, at most bits / 8 bytes (8 MB) whatever the input, so that texts nobody
    asks for are not shuffled. Where very many keys are wanted more of the others pass; a join after this removes them.
    """
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))

    bitmap = wanted.select(place(F.col(wanted.columns[0])).alias("__at")).distinct().groupBy(F.bitmap_bucket_number("__at").alias("__n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__bits"))
    bit = F.bitmap_bit_position(place(F.col(key)))
    byte = F.conv(F.hex(F.expr("substring(__bits, __byte, 1)")), 16, 10).cast("int")
    mine = docs.withColumns({"__m": F.bitmap_bucket_number(place(F.col(key))), "__byte": F.floor(bit / 8).cast("int") + 1, "__bit": F.pow(F.lit(2), bit % 8).cast("int")})
    met = (F.col("__m") == F.col("__n")) & (byte.bitwiseAND(F.col("__bit")) != 0)
    return mine.join(F.broadcast(bitmap), met, "left_semi").drop("__m", "__byte", "__bit")


def bitmap(values: DataFrame, bits: int) -> bytes:
    """One bit per value (of the only column, a long), by its last bits; `bits` is a power of two, the result bits / 8 bytes."""
    at = F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1)) + 1
    rows = values.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(max(bits // 8, 4096))
    for r in rows:
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = r["bits"]
    return bytes(out)


def with_values(rows: DataFrame, values: DataFrame, key: str, n: str, share: int = 1024) -> DataFrame:
    """rows with the columns of values, which has one row per key (null is a key) and says in `n` how many of rows have it.

    Keys that hold more than 1/share of all rows, fewer than `share` of them by that count, are sent to all tasks and
    their rows stay where they are; the others are joined by shuffle, none of them with more than that part of the rows.
    """
    total = values.agg(F.sum(n)).first()[0] or 0
    values = values.withColumnRenamed(key, "__value")
    frequent = F.col(n) * share > total
    same = F.col(key).eqNullSafe(F.col("__value"))
    often, seldom = values.where(frequent), values.where(~frequent)
    hot = rows.join(F.broadcast(often), same)
    cold = rows.join(F.broadcast(often.select("__value")), same, "left_anti").join(seldom, same)
    return hot.unionByName(cold).drop("__value", n)


def with_totals(rows: DataFrame, key: str, what: str, name: str) -> DataFrame:
    """rows (a written table) with the sum of `what` over the rows of their key, null being a key, as column `name`."""
    return with_values(rows, saved(rows.groupBy(key).agg(F.sum(what).alias(name), F.count(F.lit(1)).alias("__n")), "totals"), key, "__n")
