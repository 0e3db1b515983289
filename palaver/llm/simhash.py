"""SimHash near-duplicates by covering locality-sensitive hashing.

A covering family for radius r over 64 bits has 2^(r+1)-1 masks. Bit i is given a non-zero vector
c(i) of r+1 bits; mask v keeps the bits whose c(i) has an odd product with v. The vectors of r
differing bits span at most r dimensions, so some v is orthogonal to all of them: under that
mask the two fingerprints agree. So every pair within the radius meets in some table, with certainty.

Copies have one fingerprint, so only distinct fingerprints go through the tables, and a bucket
hands on a chain through each of its linked groups, not its pairs. A bucket larger than
``BUCKET`` isn't compared as a whole: its members agree under the mask, so they differ only in the
bits outside it, and a second covering family over just those bits splits it with the same
certainty into buckets of at most 2^17 values.

Null and empty texts have no words and the fingerprint zero; they are linked to one another like
any others. Rows with equal ids each come back; a null id never names a component while its group has another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import batches_of, stage, text_batches
from palaver.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members of a bucket that one comparison takes; larger buckets are split by the second family.
BUCKET = 4096


def hashed(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; none without a word."""
    words = (text or "").encode(errors="replace").lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes, unsigned: a bit is set if it is set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of a text; zero without a word."""
    return majority(hashed(text, size))


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The covering family over the bit positions ``bits``; all other bits are left out."""
    full = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, full + 1):
        out.append(sum(1 << b for i, b in enumerate(bits) if ((i % full + 1) & v).bit_count() & 1))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


FIRST = masks(list(range(64)))


def second(table: int) -> list[int]:
    """The second family of a table: it covers the bits that the table's mask leaves out."""
    return [FIRST[table] | m for m in masks([b for b in range(64) if not FIRST[table] >> b & 1])]


def _groups(v: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Linked groups within one bucket: grown from one member, comparing only with those not yet in a group."""
    left = v
    while len(left):
        group, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= radius
            if near.any():
                found = left[near]
                group.extend(found)
                todo.extend(found)
                left = left[~near]
        if len(group) > 1:
            yield np.sort(np.array(group, dtype=np.uint64))


def _compare(batches: Iterator[pd.DataFrame], radius: int, limit: int | None) -> Iterator[pd.DataFrame]:
    """Batches sorted by (t, k), each bucket whole within its partition. Gives links (t = -1) and members of buckets over ``limit``."""
    kept: list[np.ndarray] = []  # of the bucket that the last batch broke off in
    key, over = None, False

    def flush() -> pd.DataFrame | None:
        v = np.concatenate(kept) if kept else np.empty(0, np.uint64)
        if over or len(v) < 2:
            return None
        chains = list(_groups(v, radius))
        if not chains:
            return None
        return _rows(np.concatenate([c[:-1] for c in chains]), np.concatenate([c[1:] for c in chains]))

    for pdf in batches:
        if not len(pdf):
            continue
        t, k, fp = pdf["t"].to_numpy(), pdf["k"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
        pairs = np.flatnonzero(end - begin == 2)
        pairs = pairs[(pairs > 0) & (pairs < len(begin) - 1)]
        a, b = fp[begin[pairs]], fp[begin[pairs] + 1]
        near = np.bitwise_count(a ^ b) <= radius
        out = [_rows(a[near], b[near])]
        last = len(begin) - 1
        for i in sorted({0, last, *np.flatnonzero(end - begin > 2).tolist()}):
            here = (int(t[begin[i]]), int(k[begin[i]]))
            if here != key:
                if (x := flush()) is not None:
                    out.append(x)
                key, kept, over = here, [], False
            kept.append(fp[begin[i] : end[i]])
            if over or limit and sum(map(len, kept)) > limit:
                over = True
                out += [pd.DataFrame({"a": v.view(np.int64), "b": v.view(np.int64), "t": np.int32(key[0]), "k": np.int64(key[1])}) for v in kept]
                kept = []
        if any(map(len, out)):
            yield pd.concat([x for x in out if len(x)])
    if (x := flush()) is not None:
        yield x


def _rows(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "t": np.int32(-1), "k": np.int64(0)})


def _meet(keyed: DataFrame, radius: int, limit: int | None) -> DataFrame:
    ordered = keyed.repartition("t", "k").sortWithinPartitions("t", "k")
    return ordered.mapInPandas(lambda it: _compare(it, radius, limit), "a long, b long, t int, k long")


def _keyed(fps: DataFrame, family: list[int], table=None) -> DataFrame:
    """A row for each fingerprint and mask: the table and the bits that the mask keeps."""
    tables = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(signed(m)).alias("m")) for i, m in enumerate(family)])
    rows = fps.select("fp", F.explode(tables).alias("x"))
    return rows.select("fp", (table if table is not None else F.col("x.i")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("k"))


def links(fps: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``, long) that join all pairs within ``radius``, as a written table."""
    spark = fps.sparkSession
    with batches_of(spark, 20_000):
        first = stage(_meet(_keyed(fps, FIRST), radius, limit))
        over = first.where("t >= 0").select(F.col("a").alias("fp"), "t")
        if over.isEmpty():
            return first.select("a", "b")
        again = None
        for t in [r.t for r in over.select("t").distinct().collect()]:  # at most as many as tables
            keyed = _keyed(over.where(F.col("t") == t).select("fp"), second(t))
            keyed = keyed.withColumn("t", F.lit(1000 * (t + 1)) + F.col("t"))
            again = keyed if again is None else again.unionByName(keyed)
        return stage(first.where("t < 0").select("a", "b").unionByName(_meet(again, radius, None).select("a", "b")))


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id``, ``fp`` (long) and ``component_id`` for each row: the smallest id that links reach."""
    text_batches(df.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(simhash(t)) for t in texts], dtype="int64")

    rows = stage(df.select(F.col(id).alias("id"), fingerprint(F.col(text)).alias("fp")))
    fps = stage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(fps.select("fp"), radius))
    found = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select(F.col("id").alias(id), "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
