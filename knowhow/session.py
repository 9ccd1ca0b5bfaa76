"""Session helpers: checkpoint location and stable global ranks."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the checkpoint folder the cluster names.

    Only where that setting is empty on a local master (tests) a temporary folder is used; a cluster must name one.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, and ends growing plans."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, for loops that join their own results: a checkpoint keeps the estimated size of its plan, and
    products of such estimates grow to numbers of so many digits that planning takes longer than the work."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """0-based position of every row in the total order, without a one-task sort.

    Rows are range-partitioned on the full order (ids last, so equal scores spread out), the
    partition number is materialised, and each partition's start is the row count before it.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition: as many rows as the shuffle has partitions, whatever the data size.
    starts = sizes.withColumn(
        "_start",
        F.coalesce(
            F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).select("_part", "_start")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_local") - 1)
        .drop("_part", "_start", "_local")
    )


def rank_within(df: DataFrame, keys: list[str], *order, name: str = "position") -> DataFrame:
    """1-based position of every row within its key, also when one key holds a large share of all rows."""
    ranked = global_rank(df, *keys, *order, name="_pos")
    first = ranked.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    return ranked.join(first, keys).withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions that were started in another directory."""
    root = Path(__file__).resolve().parent.parent
    made = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "knowhow"), "zip", root, "knowhow")
    spark.sparkContext.addPyFile(made)


def local_session(cpus: int = 8, name: str = "knowhow") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark
