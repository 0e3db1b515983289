"""Collections: tables keyed by a dense ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(df: DataFrame, key: str, ordinal: int) -> DataFrame:
    """The row with this ordinal; raises IndexError where there is none."""
    found = df.where(F.col(key) == ordinal)
    if found.isEmpty():
        raise IndexError(f"no row with {key} {ordinal}")
    return found


def get_many(df: DataFrame, key: str, ordinals: list[int]) -> DataFrame:
    """A row for each asked ordinal, in that order and as often (column ``pos``); raises where one is missing."""
    asked = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(ordinals)], f"pos bigint, {key} bigint")
    if not asked.join(df, key, "left_anti").isEmpty():
        raise IndexError(f"some {key} are missing")
    return df.join(F.broadcast(asked), key)  # as long as the caller's list


def part(df: DataFrame, key: str, begin: int, end: int) -> DataFrame:
    return df.where((F.col(key) >= begin) & (F.col(key) < end))


def append(df: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """``more``, numbered after ``df`` in the order of its dense integer column ``order``, under ``df``."""
    from palaver.operators.ingest import ordinals

    base = df.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("n")).collect()[0]["n"]
    numbered = ordinals(more, order, F.lit(1), key, base)
    return df.unionByName(numbered.select(*df.columns))


def dangling(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")
