"""Shards of near equal bytes by histogram sort.

Rows are ordered by a key: 40 bits of the text's hash, then 24 bits of the id's hash. Equal texts so
stand side by side (only a boundary parts them), and a group of copies of any size can still be cut.
Splitters are found without moving a row: in each round the exact bytes and rows below candidate keys
are counted in every partition and summed, and new candidates are laid into the interval that
still holds each boundary, until every boundary meets the tolerance or two neighbouring keys enclose it.
Then the rows are exchanged once.

A shard is cut into parts that are counted in the same way, so a slot is the rows of the parts
before plus the row's number in its part, and no task sorts a whole shard.

Null text has no bytes and goes with the empty ones; null ids hash alike. Rows equal in id and text have
one key and go together. An empty table gives an empty result. Columns named like the results are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import fresh, stage

SHARDS = 40
OVERHEAD = 16
#: Of a shard's bytes, how far a boundary may be from its place.
TOLERANCE = 0.0005
#: Candidates laid into an interval in one round.
PROBES = 8
#: Bytes of a part, about.
PART_BYTES = 64 << 20


def _below(batches: Iterator[pd.DataFrame], probes: np.ndarray) -> Iterator[pd.DataFrame]:
    size, rows = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
    for pdf in batches:
        at = np.searchsorted(probes, pdf["key"].to_numpy(), side="right")
        rows += np.bincount(at, minlength=len(rows))
        np.add.at(size, at, pdf["size"].to_numpy())
    at = np.flatnonzero(rows)
    yield pd.DataFrame({"at": at, "size": size[at], "rows": rows[at]})


def histogram(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with keys below each of the sorted ``probes``."""
    parts = keys.mapInPandas(lambda it: _below(it, probes), "at long, size long, rows long")
    size, rows = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
    for r in parts.groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("n")).collect():  # one row a probe at most
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, total: int, parts: int, tolerance: np.ndarray | float) -> np.ndarray:
    """parts - 1 keys: the bytes below the j-th are within ``tolerance`` bytes (of each, or of all) of j / parts of all, as far as whole keys allow."""
    tolerance = np.broadcast_to(tolerance, parts - 1)
    goal = total * np.arange(1, parts) / parts
    low = [-(1 << 63)] * (parts - 1)  # Python integers: differences exceed 64 bits
    high = [(1 << 63) - 1] * (parts - 1)
    best, gap = [0] * (parts - 1), np.full(parts - 1, np.inf)
    first = [(1 << 64) * j // parts - (1 << 63) for j in range(1, parts)]
    near = {j: [first[j]] for j in range(parts - 1)}  # hashed keys: the even place is a good guess
    for turn in itertools.count():  # each round but the first narrows every interval to a ninth of it at most
        live = [j for j in range(parts - 1) if gap[j] > tolerance[j] and high[j] - low[j] > 1]
        if not live:
            break
        laid: set[int] = set()
        for j in live:
            laid.update(x for x in near.get(j, []) if low[j] < x < high[j])
            if turn:
                laid.update(low[j] + (high[j] - low[j]) * k // (PROBES + 1) for k in range(1, PROBES + 1))
        probes = np.array(sorted(laid), dtype=np.int64)
        size, _ = histogram(keys, probes)
        for j in live:
            off = np.abs(size - goal[j])
            if off[k := int(np.argmin(off))] < gap[j]:
                gap[j], best[j] = float(off[k]), int(probes[k])
            i = int(np.searchsorted(size, goal[j], side="left"))  # the first probe with enough below it
            below, above = low[j], high[j]
            if i > 0:
                low[j] = max(low[j], int(probes[i - 1]))
            if i < len(probes):
                high[j] = min(high[j], int(probes[i]))
            a = size[i - 1] if i > 0 and probes[i - 1] >= below else None
            b = size[i] if i < len(probes) and probes[i] <= above else None
            near[j] = []
            if a is not None and b is not None and b > a:
                guess = low[j] + int((high[j] - low[j]) * float(goal[j] - a) / float(b - a))
                step = max(1, (high[j] - low[j]) // 64)
                near[j] = [guess - step, guess, guess + step]
    return np.maximum.accumulate(np.array(best, dtype=np.int64))


def measured(df: DataFrame, id: str, text: str, size: str, key: str) -> DataFrame:
    """``df`` with the columns ``size`` and ``key`` of each row."""
    bytes_ = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    by_id = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(id)), 40)
    return df.select("*", bytes_.alias(size), F.shiftleft(F.shiftrightunsigned(hashed, 24), 24).bitwiseOR(by_id).alias(key))


def dealt(rows: DataFrame, id: str, size: str, key: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; they are exchanged once, with all their columns."""
    keys = stage(rows.select(F.col(key).alias("key"), F.col(size).alias("size")))
    whole = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()[0]
    total = whole["bytes"] or 0
    per = max(1, -(-total // (shards * PART_BYTES)))
    parts = shards * per
    close = np.where(np.arange(1, parts) % per, PART_BYTES / 4, tolerance * total / shards)  # between parts of a shard a rough cut will do
    cuts = splitters(keys, total, parts, close)
    _, below = histogram(keys, np.unique(cuts)) if whole["rows"] else (None, np.zeros(len(np.unique(cuts)), np.int64))
    start = np.concatenate(([0], below[np.searchsorted(np.unique(cuts), cuts)]))  # rows before each part
    ahead = start - start[np.arange(parts) // per * per]  # of its shard
    part, place, number = fresh(rows, "part", "place", "number")

    @F.pandas_udf("part int, ahead long")
    def place_of(keys: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(cuts, keys.to_numpy(), side="right")
        return pd.DataFrame({"part": at.astype(np.int32), "ahead": ahead[at]})

    named = rows.withColumn(place, place_of(key)).withColumn(part, F.col(place)["part"])
    named = named.withColumn(number, F.row_number().over(Window.partitionBy(part).orderBy(key, id)) - 1)
    return named.select(*rows.columns, F.floor(F.col(part) / per).cast("int").alias("shard"), (F.col(number) + F.col(place)["ahead"]).cast("long").alias("slot"))


def shard(df: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """All rows and columns of ``df`` with ``size``, ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard)."""
    own = df.select(*[F.col(c) for c in df.columns if c not in ("size", "shard", "slot")])
    (key,) = fresh(own, "key")
    return dealt(measured(own, id, text, "size", key), id, "size", key, shards, tolerance).drop(key)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    rows = measured(docs, "doc_id", "text", "size", "key").select("doc_id", "size", "key", crc)  # the digest travels, not the text
    return dealt(rows, "doc_id", "size", "key").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
