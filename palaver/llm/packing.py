"""Packing by cutting-stock column generation.

Each document's ids (with the end id) are cut into full sequences and one tail. A tail's length is
rounded up to a unit, so the histogram of tails has at most ``SIZE / UNIT`` bins at any scale and is all the
driver sees. A linear program over patterns (how many tails of each bin fill a sequence) is solved
by column generation: the simplex method's dual prices go into a knapsack, whose dynamic
program finds the pattern worth most; when none is worth more than one sequence the program is
solved. Patterns are rounded down to whole sequences, and the few tails that are left are packed first fit decreasing.
Tails are ranked within their bin, and the ranks of a bin are dealt to patterns interval by interval.

Ranks come from counts per bucket of rows, so no bin is sorted in one place. Null text is empty: its
only id is the end id. Rows with equal ids are packed each.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import stage, text_batches

SIZE = 2048
UNIT = 8
END = 1
#: Sequences by which the linear program may miss its optimum; rounding costs more.
GAP = 0.5
#: Rows that one bucket of the ranking holds, about.
BUCKET_ROWS = 50_000


# ---------------------------------------------------------------- linear program


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern worth most: items of sizes 1, 2, ... len(prices), any number of each."""
    best, item = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    sizes = np.arange(1, len(prices) + 1)
    for c in range(1, capacity + 1):
        worth = best[c - sizes[: min(c, len(sizes))]] + prices[: min(c, len(sizes))]
        k = int(np.argmax(worth))
        if worth[k] > best[c - 1] + 1e-12:
            best[c], item[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(prices), dtype=np.int64), capacity
    while c > 0:
        if item[c]:
            pattern[item[c] - 1] += 1
            c -= item[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)  # not by BLAS, whose threads wait for one another on a busy driver


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots."""
    m = len(matrix)
    both = np.hstack((matrix, np.eye(m)))
    for k in range(m):
        p = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= np.outer(factor, both[k])
    return both[:, m:]


def columns(demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each: a solution of the linear program within ``gap`` sequences of its optimum.

    If the best pattern is worth w, the optimum is at least the present value divided by w (the prices over w are feasible), which tells how far it is.
    """
    bins = np.flatnonzero(demand)
    if not len(bins):
        return []
    m = len(bins)
    need = demand[bins] + np.random.default_rng(7).uniform(1e-6, 1e-5, m)  # no ties, so no pivot is without gain and none comes back
    basis = np.diag((capacity // (bins + 1)).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    use = _times(inverse, need)
    for step in itertools.count():
        dual = inverse.sum(axis=0)
        prices = np.zeros(capacity)
        prices[bins] = np.maximum(dual, 0)
        worth, pattern = knapsack(prices, capacity)
        if worth <= 1 + 1e-7 or use.sum() * (1 - 1 / worth) < gap:
            break
        enter = pattern[bins].astype(float)
        way = _times(inverse, enter)
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = use[up] / way[up]
        out = int(np.argmin(ratio))
        theta = ratio[out]
        use = use - theta * way
        use[out] = theta
        basis[:, out] = enter
        if step % 500 == 499:
            inverse = _inverse(basis)
            use = np.maximum(_times(inverse, need), 0)
        else:
            row = inverse[out] / way[out]
            inverse = inverse - np.outer(way, row)
            inverse[out] = row
    found = []
    for j in range(m):
        pattern = np.zeros(capacity, dtype=np.int64)
        pattern[bins] = np.round(basis[:, j]).astype(np.int64)
        found.append((pattern, float(max(use[j], 0))))
    return found


def plan(demand: np.ndarray, capacity: int) -> pd.DataFrame:
    """Intervals of ranks: (bin, begin, end, per, sequence): ranks of ``bin`` in [begin, end) go ``per`` to a sequence, from ``sequence`` on."""
    left = demand.astype(np.int64).copy()
    used: list[tuple[np.ndarray, int]] = []
    for pattern, x in columns(demand, capacity):
        at = pattern > 0
        n = int(min(np.floor(x + 1e-9), (left[at] // pattern[at]).min())) if at.any() else 0
        if n > 0:
            used.append((pattern, n))
            left -= n * pattern
    while left.any():  # first fit decreasing over what rounding left, the same pattern as often as it fits
        pattern, room = np.zeros(capacity, dtype=np.int64), capacity
        for s in np.flatnonzero(left)[::-1]:
            k = int(min(left[s], room // (s + 1)))
            pattern[s], room = k, room - k * (s + 1)
        at = pattern > 0
        n = int((left[at] // pattern[at]).min())
        used.append((pattern, n))
        left -= n * pattern
    done, sequence, rows = np.zeros(capacity, dtype=np.int64), 0, []
    for pattern, n in used:
        for s in np.flatnonzero(pattern):
            k = int(pattern[s])
            rows.append((int(s), int(done[s]), int(done[s] + n * k), k, sequence))
            done[s] += n * k
        sequence += n
    return pd.DataFrame(rows, columns=["bin", "begin", "end", "per", "sequence"])


# ---------------------------------------------------------------- Spark


class Ids:
    """Token ids by the vocabulary file; the same vocabulary as ranks gives the same ids several times faster."""

    def __init__(self, vocabulary: str, ranks: str | None):
        self.vocabulary, self.slow, self.fast = vocabulary, None, None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError as e:
                if "regex" not in str(e).lower():  # a run of white space too long for its pattern engine
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
        return self.slow.encode(text, add_special_tokens=False).ids


def _pieces(batches: Iterator[pd.DataFrame], vocabulary: str, ranks: str | None, size: int) -> Iterator[pd.DataFrame]:
    encode = Ids(vocabulary, ranks)
    for pdf in batches:
        rows = []
        for id, text in zip(pdf["id"], pdf["text"], strict=True):
            ids = np.array([*encode(text or ""), END], dtype="<u4")
            for a in range(0, len(ids), size):
                part = ids[a : a + size]
                rows.append((id, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
        yield pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens"])


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, id: str = "doc_id", text: str = "text", size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long)."""
    spark = docs.sparkSession
    text_batches(spark)
    kind = dict(docs.dtypes)[id]
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stage(own.mapInPandas(lambda it: _pieces(it, vocabulary, ranks, size), schema))
    full = pieces.where(F.col("length") == size)
    tails = pieces.where(F.col("length") < size).withColumn("bin", F.ceil(F.col("length") / unit).cast("int") - 1)

    n = tails.count()
    buckets = max(8, -(-n // BUCKET_ROWS))
    spread = F.pmod(F.xxhash64("id", "start", "length", "ids_crc32"), F.lit(buckets)).cast("int")
    tails = tails.withColumn("bucket", spread)
    counts = tails.groupBy("bin", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stage(counts.select("bin", "bucket", "count", before.alias("before")))
    demand = np.zeros(size // unit, dtype=np.int64)
    for r in counts.groupBy("bin").agg(F.sum("count").alias("n")).collect():  # size / unit rows at most
        demand[r["bin"]] = r["n"]
    intervals = plan(demand, size // unit)
    sequences = int((intervals["sequence"] + (intervals["end"] - intervals["begin"]) // intervals["per"]).max()) if len(intervals) else 0

    within = Window.partitionBy("bin", "bucket").orderBy("length", "id", "start", "ids_crc32")
    ranked = tails.withColumn("row", F.row_number().over(within) - 1).join(counts.drop("count"), ["bin", "bucket"])
    ranked = ranked.withColumn("rank", F.col("row") + F.col("before")).drop("row", "before", "bucket")
    by_bin = {int(b): g.sort_values("begin")[["begin", "per", "sequence"]].to_numpy() for b, g in intervals.groupby("bin")}

    @F.pandas_udf("long")
    def dealt(bins: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.zeros(len(bins), dtype=np.int64)
        b, r = bins.to_numpy(), ranks.to_numpy()
        for k in np.unique(b):
            at, table = np.flatnonzero(b == k), by_bin[int(k)]
            i = np.searchsorted(table[:, 0], r[at], side="right") - 1
            out[at] = table[i, 2] + (r[at] - table[i, 0]) // table[i, 1]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", dealt("bin", "rank"))
    together = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(together), F.lit(0)))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # full pieces take the numbers after the packed ones: counted by file partition, numbered within
    full = full.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets_of(full))).cast("int"))
    # a bucket's start: prefix sums within blocks of a thousand buckets, and over the blocks' totals
    filled = stage(full.groupBy("bucket").count().withColumn("block", F.floor(F.col("bucket") / 1000)))
    so_far = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = filled.groupBy("block").agg(F.sum("count").alias("count"))
    blocks = blocks.select("block", so_far(Window.orderBy("block")).alias("base"))
    filled = filled.withColumn("own", so_far(Window.partitionBy("block").orderBy("bucket"))).join(blocks, "block")
    filled = filled.select("bucket", (F.col("base") + F.col("own")).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("id", "start", "ids_crc32")) - 1
    full = full.withColumn("number", number).join(filled, "bucket")
    full = full.withColumn("sequence_id", (F.lit(sequences) + F.col("ahead") + F.col("number")).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(*names).unionByName(full.select(*names)).withColumnRenamed("id", id)


def buckets_of(rows: DataFrame) -> int:
    return max(8, -(-rows.count() // BUCKET_ROWS))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
