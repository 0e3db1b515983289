"""One document of each group of near copies: SimHash and sampled fingerprints find candidates, exact Jaccard similarity links them.

A text's set holds the hashes (64 bits) of its ``SHINGLE``-word shingles, words as in ``simhash``; a shorter text is one
shingle, and a null or empty one has the empty set, equal to others like it. Texts of equal sets are one node.

Candidates come in rounds. First those whose SimHash fingerprints over these shingles the covering tables of ``simhash`` link
within its radius. A similarity of 0.8 leaves 3 to 13 differing bits, more than covering masks can reach (their number
doubles with each bit), so the rounds after it take fingerprints of samples: ``BANDS`` keys over ``ROWS`` MinHash samples each. Two
sets of similarity 0.8 agree in a key with probability 0.8^4, and miss one another in all 32 with probability 5e-8.

In a bucket nodes come in the order of their least rows; each is compared exactly with those of the groups it isn't in yet, a
group being a component of the links found so far, so a link between any two groups is found and none within a group is
looked for. A later round leaves out the buckets that are one component by then. No pairs are made but the links. Buckets of the
same members are compared once. A bucket of over ``BUCKET`` nodes is dealt into parts by hash, and then, as long as that halves them, the
first nodes of the groups that are left, so that a large group of near copies becomes one. What such buckets still hold of different groups
is compared exactly at the end: two similar sets share a shingle of their first fifth and one more in any order, and with the rarest first the
nodes that share one are few. Those of a shingle that is in over ``BUCKET`` such beginnings meet in blocks, each block with each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import simhash
from palaver.llm.common import fresh, release, stage, text_batches
from palaver.llm.graph import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 4
#: The sampled fingerprints of each round after the first.
ROUNDS = ((0, 2), (2, 8), (8, BANDS))
#: Nodes that are compared in one task.
BUCKET = 2048
#: Cells of the table by which shingles are ordered as rare or frequent; the order needn't be exact, only the same for all.
CELLS = 1 << 16
_RNG = np.random.default_rng(20240517)
XORS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
TIMES = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
#: Shingles that are permuted at a time, whatever the length of a text.
PIECE = 4096


def shingles(text: str | None) -> np.ndarray:
    """The sorted, different hashes of a text's shingles."""
    return np.unique(simhash.hashed(text, SHINGLE))


def bands(own: np.ndarray) -> np.ndarray:
    """The keys of a set's buckets. Samples are of 32 bits of the hashes, which a processor permutes several at a time."""
    least, half = np.full(BANDS * ROWS, ~np.uint32(0)), (own >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(half), PIECE):
        x = half[None, k : k + PIECE] ^ XORS
        x *= TIMES
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, x.min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def prefix(own: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """A set's least fifth and one more, of which two similar sets each have one of the other; ``often``: the rarest of it, by cells."""
    n = len(own) - int(np.ceil(SIMILAR * len(own) - 1e-9)) + 1
    if often is None:
        return own[:n]
    return own[np.lexsort((own, often[(own % np.uint64(CELLS)).astype(np.int64)]))[:n]]


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fps, nodes, keys = [], [], []
        for text in pdf["text"]:
            every = simhash.hashed(text, SHINGLE)
            own = np.unique(every)
            fps.append(simhash.signed(simhash.majority(every)))
            nodes.append(simhash.signed(xxhash.xxh3_64_intdigest(own.tobytes())))
            keys.append(bands(own).view(np.int64))
        yield pdf.drop(columns="text").assign(node=np.array(nodes, dtype=np.int64), fp=np.array(fps, dtype=np.int64), bands=keys)


class Bucket:
    """The nodes of a bucket so far, in groups: those of one component, joined by the links found here."""

    def __init__(self) -> None:
        self.roots: list[int] = []
        self.sets: list[np.ndarray] = []
        self.up: dict[int, int] = {}
        #: For a shingle the members that have it among their least ones, a list for each group.
        self.early: dict[int, list[list[int]]] = {}

    def group(self, root: int) -> int:
        while (to := self.up.get(root, root)) != root:
            self.up[root] = self.up.get(to, to)
            root = to
        return root

    def add(self, root: int, own: np.ndarray, often: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links (a, b) of a node's root to those of members of other groups; one for each group it is similar to."""
        begin = prefix(own, often).tolist()
        links, seen = [], set()
        for some in (1, None):  # mostly a group's first member is similar, or none
            tried: set[int] = set()
            for h in begin:
                for members in self.early.get(h, ()):
                    if self.group(self.roots[members[0]]) != self.group(root):
                        tried.update(members[:some])
            for k in sorted(tried - seen):
                if self.group(self.roots[k]) != self.group(root) and similar(own, self.sets[k]):
                    links.append((self.roots[k], root))
                    self.up[self.group(root)] = self.group(self.roots[k])
            seen = tried
        for h in begin:
            lists = self.early.setdefault(h, [])
            for members in lists:
                if self.group(self.roots[members[0]]) == self.group(root):
                    members.append(len(self.roots))
                    break
            else:
                lists.append([len(self.roots)])
        self.roots.append(root)
        self.sets.append(own)
        return links


def _linked(batches: Iterator[pd.DataFrame], often: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Links (a, b) between roots from rows (bucket, part, root, text), each part of a bucket whole and in order."""
    here, bucket = None, Bucket()
    for pdf in batches:
        out = []
        for *at, root, text in zip(pdf["bucket"], pdf["part"], pdf["root"], pdf["text"], strict=True):
            if at != here:
                here, bucket = at, Bucket()
            out += bucket.add(root, shingles(text), often)
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many shingles of the texts fall in each cell."""
    often = np.zeros(CELLS, np.int64)
    for pdf in batches:
        every = np.concatenate([np.empty(0, np.uint64), *[shingles(t) for t in pdf["text"]]])
        often += np.bincount((every % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    yield pd.DataFrame({"cell": np.arange(CELLS), "n": often})


def _begun(batches: Iterator[pd.DataFrame], often: np.ndarray) -> Iterator[pd.DataFrame]:
    """(bucket, node): each node with the shingles of its beginning."""
    for pdf in batches:
        begins = [prefix(shingles(t), often).view(np.int64) for t in pdf["text"]]
        yield pd.DataFrame({"bucket": np.concatenate([np.empty(0, np.int64), *begins]), "node": np.repeat(pdf["node"].to_numpy(), [len(b) for b in begins])})


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with their ``root`` of now; a node that ``roots`` doesn't have is its own."""
    return members.drop("root", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` between roots."""
    if links.isEmpty():
        return roots
    step = components(links)
    moved = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    return stage(moved.unionByName(step.join(roots, "node", "left_anti")))


def _several(members: DataFrame) -> DataFrame:
    """Of rows (bucket, node, root, at) those in buckets of two or more components, one bucket of each set of members; ``n``: its nodes."""
    sizes = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    once = stage(sizes.where("low <> high").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    return stage(members.join(once, "bucket").select("bucket", "node", "root", "at", "n"))


def _met(rows: DataFrame, texts: DataFrame, roots: DataFrame, often: np.ndarray | None = None) -> DataFrame:
    """``roots`` after the links within each part of each bucket; rows (bucket, part, node, root, at)."""
    rows = rows.join(texts, "node").select("bucket", F.col("part").cast("long").alias("part"), "root", "at", "text")
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "at").select("bucket", "part", "root", "text")
    links = stage(rows.mapInPandas(partial(_linked, often=often), "a long, b long"))
    roots = _joined(roots, links)
    release(rows.sparkSession, links)
    return roots


def _compared(met: DataFrame, texts: DataFrame, roots: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """``roots`` after the links of all buckets; and the members of those of over ``limit`` nodes, of whose groups some may still have links."""
    spark, whole = met.sparkSession, None
    for k in itertools.count():
        dealt = F.pmod(F.xxhash64("node", F.lit(k)), F.ceil(F.col("n") / limit))
        roots = _met(met.withColumn("part", F.when(F.col("n") > limit, dealt).otherwise(0)), texts, roots)
        large = met.where(F.col("n") > limit)
        before = large.count()
        if not before:
            release(spark, met)
            return roots, whole
        if whole is None:
            whole = stage(large.select("bucket", "node", "at"))
        left = stage(_rooted(large, roots).groupBy("bucket", "root").agg(F.min_by("node", "at").alias("node"), F.min("at").alias("at")))
        release(spark, met)
        met = _several(left)
        release(spark, left)
        if 2 * met.count() > before:
            release(spark, met)
            return roots, whole


def _rest(nodes: DataFrame, texts: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """``roots`` after all links between ``nodes`` (node, at), whichever buckets they were in."""
    spark = nodes.sparkSession
    own = stage(nodes.join(texts, "node").select("node", "at", "text"))
    often = np.zeros(CELLS, np.int64)
    for r in own.select("text").mapInPandas(_cells, "cell int, n long").groupBy("cell").sum("n").collect():  # CELLS rows
        often[r[0]] = r[1]
    begun = own.select("node", "text").mapInPandas(partial(_begun, often=often), "bucket long, node long")
    members = stage(begun.join(own.select("node", "at"), "node"))
    met = _several(_rooted(members, roots))
    roots = _met(met.where(F.col("n") <= limit).withColumn("part", F.lit(0)), texts, roots, often)
    large = stage(_rooted(met.where(F.col("n") > limit), roots))
    release(spark, own, members, met)
    met = _several(large)
    left = stage(_rooted(met, roots).select("node", "root", "at").distinct())
    release(spark, large, met)
    blocks = -(-2 * left.count() // limit)
    if blocks:
        # a block goes to its meeting with each other one; blocks hold half of what one task takes
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        rows = left.withColumn("x", F.pmod(F.xxhash64("node"), F.lit(blocks))).withColumn("y", every).where("x <> y")
        roots = _met(rows.select(F.least("x", "y").alias("bucket"), F.greatest("x", "y").alias("part"), "node", "root", "at"), texts, roots, often)
    release(spark, left)
    return roots


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", limit: int = BUCKET) -> DataFrame:
    """Of each group of near copies exactly one row, all columns: that of the smallest id, a null id last.

    Rows are told apart by id and text; of rows with equal ids the one whose text hashes lowest comes first.
    """
    spark = df.sparkSession
    text_batches(spark)
    k1, k2 = fresh(df, "k1", "k2")
    docs = df.withColumns({k1: F.coalesce(F.xxhash64(id), F.lit(0)), k2: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    own = docs.select(F.col(id).alias("id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text).alias("text"))
    schema = f"id {dict(df.dtypes)[id]}, k1 long, k2 long, node long, fp long, bands array<long>"
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "k2", "k1")
    rows = stage(own.mapInPandas(_sketches, schema).withColumn("at", order))
    nodes = stage(rows.groupBy("node").agg(F.min("at").alias("at"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    release(spark, rows)
    roots = components(simhash.links(nodes.select("fp").distinct()))
    own_root = F.col("node").alias("root")
    alike = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", own_root, "at", F.coalesce("root", "fp").alias("bucket"))
    sampled = lambda low, high: nodes.select("node", own_root, "at", F.explode(F.slice("bands", low + 1, high - low)).alias("bucket"))
    every = [_several(members) for members in (alike, *[sampled(*r) for r in ROUNDS])]
    asked = _union([met.select("node", "at") for met in every])
    asked = asked.select("node", F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).distinct()
    texts = stage(own.join(asked, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]))
    roots, wholes = spark.createDataFrame([], "node long, root long"), []
    for k, met in enumerate(every):
        if k:  # a bucket that is one component already has nothing to add
            left = stage(_rooted(met, roots))
            release(spark, met)
            met = _several(left)
            release(spark, left)
        roots, whole = _compared(met, texts, roots, limit)
        if whole is not None:
            wholes.append(whole)
    if wholes:  # several groups of a large bucket may have links that no part showed
        met = _several(_rooted(_union(wholes), roots))
        release(spark, *wholes)
        if not met.isEmpty():
            roots = _rest(met.select("node", "at").distinct(), texts, roots, limit)
        release(spark, met)
    release(spark, texts)
    found = nodes.select("node", "at").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = stage(found.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.k1").alias(k1), F.col("at.k2").alias(k2)))
    release(spark, nodes)
    return docs.join(kept, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*df.columns)
