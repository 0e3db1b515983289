"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased and cut into words of letters and digits. A mask selects six of the words of
a short span and ignores the others; equal hashes of selected words in a document and in a
benchmark item are a hit. A hit fixes how item and document lie on each other; around it the words
are compared in place, and an overlap of ``WINDOW`` words of which four fifths agree, or of all words
of a shorter item, marks the document. The two masks were found by search over all pairs of
positions: whichever two of 13 words are replaced, one of the masks fits beside them, so
an overlap with up to two substitutions can't be missed.

Null and empty texts and items have no words and take no part. Items shorter than a mask are
compared through their words' whole sequence. Rows with equal ids count as one document. A window that
agrees as well as another later in the document gives way to none: the first is named. Extra columns pass through ``clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import fresh, stage

#: Selected positions. Fixed values, together complete for two substitutions in 13 words.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW = 13
#: Words of a window that must agree: four fifths of it.
NEEDED = 11
#: Bytes of a table that may be sent to every executor; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of a row of the hash table or of hits, about.
ROW_BYTES = 64
#: Words of 64 bits in the filter that spares hashes, none of which is in a large table, the shuffle: 8 MB.
FILTER_WORDS = 1 << 20


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(words: str) -> Column:
    """An array of (hash, position) for all masks over the words column."""

    def of(mask: tuple[int, ...]) -> Column:
        last = F.size(words) - mask[-1] - 1
        at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        hashes = F.transform(at, lambda i: F.xxhash64(F.lit(mask[-1]), *[F.get(F.col(words), i + k) for k in mask]))
        return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))

    return F.array(*[of(m) for m in MASKS])


def _runs(n: int) -> Column:
    """An array of (hash, position) for all runs of ``n`` words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    return F.transform(starts, lambda i: F.struct(F.xxhash64(F.lit(n), F.array_join(F.slice(F.col("words"), i + 1, n), " ")).alias("h"), i.alias("shift")))


def _hashes(df: DataFrame, id: str) -> DataFrame:
    """id, position, hash: a row for each mask and position."""
    by_mask = df.select(id, F.explode(_seeds("words")).alias("h"))
    return by_mask.select(id, F.posexplode("h").alias("pos", "h"))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _met(hashes: DataFrame, seeds: DataFrame, size: int) -> DataFrame:
    """``hashes`` joined to ``seeds`` on ``h``. Beside a table too large to be sent, a bitmap of its hashes, whose size is fixed, goes first."""
    if size <= BROADCAST_BYTES:
        return hashes.join(F.broadcast(seeds), "h")
    word = lambda: F.pmod(F.shiftrightunsigned("h", 6), F.lit(FILTER_WORDS)).cast("int")
    bits = seeds.groupBy(word().alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(h & 63)))").alias("bits"))
    bits = stage(F.broadcast(seeds.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("word"))).join(bits, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits")))
    bitmap = bits.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bitmap"))
    some = hashes.crossJoin(F.broadcast(bitmap)).where(F.getbit(F.get("bitmap", word()), F.expr("int(h & 63)")) == 1)  # one row
    return some.drop("bitmap").join(seeds, "h")


def overlaps(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, item_id, begin, length, agree): for each document and item the best overlap of the window; only documents that overlap.

    ``begin`` is the document's word at which the item's compared window begins.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stage(items.select("item_id", "words", F.size("words").alias("n")))
    own = docs.select(F.col(id).alias("id"), tokens(F.col(text)).alias("words"))

    longest = max(m[-1] for m in MASKS) + 1
    seeds = _hashes(items.where(F.col("n") >= min(m[-1] for m in MASKS) + 1), "item_id").withColumnRenamed("pos", "ipos")
    seeds = stage(seeds.distinct())
    hits = _met(_hashes(own, "id"), seeds, ROW_BYTES * seeds.count())
    hits = hits.select("id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"))
    short = items.where(F.col("n") < longest)
    if not short.isEmpty():  # few words: the sequence itself is the seed, whatever its length
        sizes = sorted(r.n for r in short.select("n").distinct().collect())  # fewer than ``longest``
        whole = short.select("item_id", F.xxhash64("n", F.array_join("words", " ")).alias("h"))
        runs = F.flatten(F.array(*[_runs(n) for n in sizes]))
        at = own.select("id", F.explode(runs).alias("x")).select("id", "x.h", "x.shift")
        whole = stage(whole.distinct())
        hits = hits.unionByName(_met(at, whole, ROW_BYTES * whole.count()).select("id", "item_id", "shift"))
    hits = stage(hits.distinct())
    letters = items.agg(F.coalesce(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 32)), F.lit(0))).collect()[0][0]

    lists = hits.groupBy("id").agg(F.collect_set(F.struct("item_id", "shift")).alias("hits"))
    some = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(_small(lists, ROW_BYTES * hits.count()), "id")
    found = some.select("id", tokens(F.col("text")).alias("words"), F.explode("hits").alias("x"))  # words of the rows that are hit alone
    pairs = found.select("id", "words", "x.item_id", "x.shift").join(
        _small(items.select("item_id", F.col("words").alias("item"), "n"), letters), "item_id"
    )
    k = lambda i: F.get(F.col("words"), i + F.col("shift"))
    equal = F.transform(F.col("item"), lambda w, i: F.when((i + F.col("shift") >= 0) & k(i).eqNullSafe(w), 1).otherwise(0))
    pairs = pairs.select("id", "item_id", "shift", F.least("n", F.lit(WINDOW)).alias("w"), equal.alias("equal"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("equal") - F.col("w")),
        lambda s: F.struct(
            reduce(lambda a, b: a + b, [F.when(F.lit(j) < F.col("w"), F.coalesce(F.get(F.col("equal"), s + j), F.lit(0))).otherwise(0) for j in range(WINDOW)]).alias("agree"),
            (-s).alias("at"),
        ),
    )
    best = pairs.select("id", "item_id", "shift", "w", F.array_max(sums).alias("best"))
    best = best.where(F.col("best.agree") >= F.when(F.col("w") < WINDOW, F.col("w")).otherwise(NEEDED))
    least = F.max(F.struct("best.agree", (-(F.col("shift") - F.col("best.at"))).alias("begin"), "w")).alias("m")
    return best.groupBy("id", "item_id").agg(least).select(
        F.col("id").alias(id), "item_id", (-F.col("m.begin")).cast("long").alias("begin"), F.col("m.w").cast("long").alias("length"), F.col("m.agree").cast("long").alias("agree")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have no overlap with the benchmark, all columns. Rows are told apart by their text, whatever their id."""
    (key,) = fresh(docs, "key")
    own = docs.withColumn(key, F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), F.col(text)).alias("y")))
    bad = overlaps(own.select(key, F.col(text).alias("text")), benchmark, key).select(key).distinct()
    return own.join(bad, key, "left_anti").select(*docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
