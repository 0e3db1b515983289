"""Vector arithmetic on array columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors have different dimensions")).cast("double"))


def cosine(a: Column, b: Column, checked: bool = True) -> Column:
    """Zero for a zero vector; raises for different dimensions if ``checked``."""
    size = norm(a) * norm(b)
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))
    return same_size(a, b, value) if checked else value


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalize(a: Column) -> Column:
    """Of length one; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / F.nullif(size, F.lit(0.0))))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def mean(df: DataFrame, column: str) -> DataFrame:
    """One row: the element-wise mean. Vectors are summed before any shuffle."""
    parts = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(column))  # one entry a dimension


def score(distance: Column, backend: str = "exact", cosine_mode: bool = False) -> Column:
    """The score of a distance: 1 / (1 + d) by default, 1 - d / 2 for the graph index, the product itself for inner products."""
    if cosine_mode:
        return 1 - distance
    return {"exact": 1 / (1 + distance), "hnsw": 1 - distance / 2, "ip": distance}[backend]
