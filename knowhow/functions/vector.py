"""Vector expressions on array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a) -> Column:
    """L2-normalised copy in double precision; the zero vector stays zero."""
    a = F.col(a) if isinstance(a, str) else a
    length = F.transform(F.array(norm(a)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))
    return F.flatten(F.transform(length, lambda n: F.transform(a, lambda v: v.cast("double") / n)))


def parse_vector(text) -> Column:
    """Vectors that arrive as JSON text."""
    return F.from_json(text, "array<float>")


def mean_vectors(df: DataFrame, keys: list[str], vec: str, weight: str | None = None, out: str = "vec") -> DataFrame:
    """Unit-length (weighted) mean vector per key; partial means are combined before the shuffle."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    agg = Summarizer.mean(v, F.col(weight)) if weight else Summarizer.mean(v)
    grouped = df.groupBy(*keys).agg(agg.alias("_m"))
    return grouped.withColumn("_m", vector_to_array("_m")).select(*keys, unit("_m").alias(out))
