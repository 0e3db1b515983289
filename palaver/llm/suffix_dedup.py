"""Repeated strings by a hash-compared suffix sort.

Every byte that lies in a ``length``-byte string that also starts anywhere else is found, exactly. The strings are the
text's UTF-8 bytes (``BYTEWISE``) or its words, each written as the 8 bytes of its hash (``WORDWISE``: 51 words).

1. Anchors. In each ``length``-byte window the last of the ``gram``-byte strings with the smallest
   polynomial hash is an anchor. The choice depends on the window alone, so two equal windows have
   equal anchors at the same place; about two positions in 340 are anchors. An anchor's context is
   all that any window around it can hold: up to ``length - gram`` bytes before it and ``length`` from it on.
2. Anchors whose strings occur once are dropped. Contexts that are equal as a whole (128 bits of BLAKE2b over the
   context and the anchor's place in it) are combined before the shuffle: they are covered, however many copies there are.
3. The different contexts of one anchor are suffix-sorted to the right and, reversed, to the left: a
   mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes.
   Neighbours' extensions are checked byte by byte; a collision repeats the sort with another base.
   Two contexts share the window that begins d bytes before the anchor if their common extensions reach
   d to the left and ``length - d`` to the right; runs of the two orders tell which do, for each d.
4. An anchor with over ``GROUP`` different contexts (a passage that very many documents share) isn't
   gathered: its range of d is halved again and again, the members keyed by the bytes that all windows
   of a half have in common. What is alone drops out, what is equal as a whole is covered, and groups that have become
   small enough are sorted as in 3 for their part of d. Counts are combined before the shuffle.

Counts are written before rows are joined to them, so that a key which holds a large share of the rows is only ever
joined, never gathered, and adaptive execution splits its partition.

Matches never cross rows. Null and empty texts have no bytes; texts shorter than ``length`` lose
nothing. Rows equal in id and text are copies of each other like any equal texts. Text of any length is hashed
piece by piece; a character of which only some bytes repeat goes whole in ``drop_repeats``. Columns of any name pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import batches_of, fresh, release, stage, text_batches

LENGTH = 400
GRAM = 64
#: Words of a window by words, and of the strings that its anchors are.
WORDS, GRAM_WORDS = 51, 5
#: Bytes that are hashed at a time, whatever the length of a text.
PIECE = 1 << 19
#: Different contexts of one anchor that are sorted together; beyond it they are split.
GROUP = 8192
#: Contexts that one sort takes at least, of many anchors.
SORTED = 2048

BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BASE = 0x9E3779B97F4A7C15
POWERS = _powers(BASE, PIECE * 2 + 2)
INVERSE = _powers(pow(BASE, -1, 1 << 64), PIECE * 2 + 2)


def _utf8(text: str) -> bytes:
    return text.encode()


def _words(text: str) -> bytes:
    """The words of a text, each as 8 bytes: the 64 bits of its hash."""
    return np.array([xxhash.xxh64_intdigest(w) for w in text.encode().split()], dtype="<u8").tobytes()


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end in its bytes."""
    space = np.isin(np.frombuffer(text, dtype=np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8))
    step = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


@dataclass(frozen=True)
class Strings:
    """What is compared: how a text becomes bytes, a window's length, an anchor's, and the bytes of one symbol."""

    coded: Callable[[str], bytes] = _utf8
    length: int = LENGTH
    gram: int = GRAM
    width: int = 1


BYTEWISE = Strings()
WORDWISE = Strings(_words, WORDS * 8, GRAM_WORDS * 8, 8)


def _minima(buf: np.ndarray, valid: np.ndarray, kind: Strings) -> np.ndarray:
    """Positions, in symbols, of the anchors of the windows whose starts are ``valid``."""
    symbols, gram = (BYTES[buf] if kind.width == 1 else buf.view("<u8")), kind.gram // kind.width
    n, w = len(symbols) - gram + 1, (kind.length - kind.gram) // kind.width + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * POWERS[: len(symbols)], dtype=np.uint64)))
    key = (sums[gram:] - sums[:-gram]) * INVERSE[:n]
    key *= np.uint64(0xD6E8FEB86659FD93)  # the high bits decide, and low bits of a polynomial know few bytes
    key = (key & ~LOW) | (LOW - np.arange(n, dtype=np.uint64))
    rows = -(-n // w)
    full = np.full(rows * w, ~np.uint64(0))
    full[:n] = key
    full = full.reshape(rows, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(valid[: n - w + 1])
    least = np.minimum(behind[starts], ahead[starts + w - 1])
    flag = np.zeros(n, dtype=bool)
    flag[(LOW - (least & LOW)).astype(np.int64)] = True
    return np.flatnonzero(flag)


def anchors(texts: list[bytes], kind: Strings = BYTEWISE) -> Iterator[tuple[int, int]]:
    """(index of the text, position) of each anchor, in order."""
    length = kind.length
    pieces: list[tuple[int, int, bytes, int]] = []  # text, its offset, bytes, number of windows (one begins at each symbol)

    def flush() -> list[tuple[int, int]]:
        buf = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(p[2]) // kind.width for p in pieces])))
        valid = np.zeros(len(buf) // kind.width, dtype=bool)
        for b, p in zip(begin, pieces, strict=False):
            valid[b : b + p[3]] = True
        at = _minima(buf, valid, kind)
        which = np.searchsorted(begin, at, side="right") - 1
        own = np.array([p[0] for p in pieces])[which]
        pos = (at - begin[which]) * kind.width + np.array([p[1] for p in pieces])[which]
        pieces.clear()
        return list(zip(own.tolist(), pos.tolist(), strict=True))

    last, filled = (-1, -1), 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - length + 1, PIECE):
            windows = min(PIECE // kind.width, (len(t) - length - a) // kind.width + 1)
            part = t[a : a + (windows - 1) * kind.width + length]
            if pieces and filled + len(part) > PIECE + length:
                for x in flush():
                    if x > last:  # slices of a long text meet in an anchor
                        yield (last := x)
                filled = 0
            pieces.append((i, a, part, windows))
            filled += len(part)
    if pieces:
        for x in flush():
            if x > last:
                yield (last := x)


def _found(batches: Iterator[pd.DataFrame], kind: Strings) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [kind.coded(t or "") for t in pdf["text"]]
        k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
        rows, digests = [], []
        for i, p in anchors(texts, kind):
            t = texts[i]
            left, right = min(p, kind.length - kind.gram), min(kind.length, len(t) - p)
            rows.append((xxhash.xxh64_intdigest(t[p : p + kind.gram]), i, p, left, right))
            digests.append(hashlib.blake2b(t[p - left : p + right], digest_size=16, salt=left.to_bytes(8, "little")).digest())
        if rows:
            g, i, p, left, right = zip(*rows, strict=True)
            i, c = np.array(i), np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            g = np.array(g, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"g": g, "c": c[:, 0], "c2": c[:, 1], "k1": k1[i], "k2": k2[i], "pos": p, "l": left, "r": right})


def _contexts(batches: Iterator[pd.DataFrame], kind: Strings) -> Iterator[pd.DataFrame]:
    """The contexts of the anchors ``want`` of each text."""
    for pdf in batches:
        rows = []
        for k1, k2, text, want in zip(pdf["k1"], pdf["k2"], pdf["text"], pdf["want"], strict=True):
            t = kind.coded(text)
            for w in want:
                rows.append((w["g"], k1, k2, w["pos"], w["l"], w["r"], t[w["pos"] - w["l"] : w["pos"] + w["r"]], w["hot"]))
                if len(rows) == 20_000:
                    yield pd.DataFrame(rows, columns=CONTEXT)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=CONTEXT)


# ---------------------------------------------------------------- suffix sort


def suffix_sort(text: np.ndarray, at: np.ndarray, most: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes text[at : at + most] within their groups [begin, end), and each one's common extension with the one before it in its group (0 for the first)."""
    powers = POWERS[: len(text) + 1] if base == BASE and len(text) < len(POWERS) else _powers(base, len(text) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((BYTES[text] if text.dtype == np.uint8 else text) * powers[:-1], dtype=np.uint64)))

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = at[i], at[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(most[i], most[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (sums[x + mid] - sums[x]) * powers[y] == (sums[y + mid] - sums[y]) * powers[x]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def below(i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        n = extension(i, j)
        ended = n >= np.minimum(most[i], most[j])
        a, b = text[np.minimum(at[i] + n, len(text) - 1)], text[np.minimum(at[j] + n, len(text) - 1)]
        return np.where(ended, (most[i] < most[j]) | ((most[i] == most[j]) & ties), a < b)

    order, slot = np.arange(len(at)), np.arange(len(at))
    local, width = slot - begin, 1
    while width < (end - begin).max(initial=0):
        run = local // width
        other = begin + (run ^ 1) * width
        live = np.flatnonzero(other < end)
        me, low, high = order[live], other[live].copy(), np.minimum(other + width, end)[live]
        first, odd = low.copy(), (run[live] & 1).astype(bool)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            # ties keep the left run before the right run
            less = below(order[mid], me[open_], odd[open_])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        to = slot.copy()
        to[live] = begin[live] + (run[live] >> 1) * 2 * width + local[live] % width + (low - first)
        new = np.empty_like(order)
        new[to] = order
        order, width = new, width * 2
    common = np.zeros(len(at), np.int64)
    rest = np.flatnonzero(slot > begin)
    common[rest] = extension(order[rest - 1], order[rest])
    for k in range(0, len(rest), 2048):  # verification
        part = rest[k : k + 2048]
        x, y, n = at[order[part - 1]], at[order[part]], common[part]
        step = np.arange(n.max(initial=0))
        differ = (text[np.minimum(x[:, None] + step, len(text) - 1)] != text[np.minimum(y[:, None] + step, len(text) - 1)]) & (step < n[:, None])
        if differ.any():
            return suffix_sort(text, at, most, begin, end, (base * 0x5851F42D4C957F2D + 0x14057B7EF767814E) % (1 << 64) | 1)
    return order, common


def shared_windows(groups: np.ndarray, contexts: list[bytes], left: np.ndarray, right: np.ndarray, kind: Strings = BYTEWISE) -> np.ndarray:
    """For each context (groups sorted) and each d: does another context of its group hold the window that begins d symbols before the anchor?"""
    n, length = len(contexts), kind.length // kind.width
    left, right = left // kind.width, right // kind.width
    steps = np.arange(0, length - kind.gram // kind.width + 1)
    cut = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    sizes = np.diff(np.concatenate(([0], cut, [n])))
    begin, end = np.repeat(np.concatenate(([0], cut)), sizes), np.repeat(np.concatenate((cut, [n])), sizes)
    text = np.frombuffer(b"".join(contexts), dtype=np.uint8 if kind.width == 1 else "<u8")
    at = np.concatenate(([0], np.cumsum([len(c) // kind.width for c in contexts])[:-1])) + left
    to_right, ext_right = suffix_sort(text, at, right, begin, end)
    to_left, ext_left = suffix_sort(np.ascontiguousarray(text[::-1]), len(text) - at, left, begin, end)

    def most(order: np.ndarray, ext: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        after = np.append(ext[1:], 0)
        after[end - 1] = 0
        out[order] = np.maximum(ext, after)
        return out

    shared = np.zeros((n, len(steps)), dtype=bool)
    some = most(to_right, ext_right) + most(to_left, ext_left) >= length
    if not some.any():
        return shared
    first = begin == np.arange(n)
    keep = np.flatnonzero(some)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, d in enumerate(steps):
        a[to_left] = np.cumsum(first | (ext_left < d))
        b[to_right] = np.cumsum(first | (ext_right < length - d))
        key = a[keep] * (n + 1) + b[keep]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(keep), dtype=bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        shared[keep[hit], k] = True
    fits = (steps <= left[:, None]) & (length - steps <= right[:, None])
    return shared & fits


def _covered(shared: np.ndarray, pos: np.ndarray, kind: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of d as byte ranges: row, begin, end."""
    padded = np.zeros((len(shared), shared.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = shared
    step = np.diff(padded, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return row, pos[row] - (high - 1) * kind.width, pos[row] - low * kind.width + kind.length


def _compared(batches: Iterator[pd.DataFrame], kind: Strings) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        shared = shared_windows(pdf["g"].to_numpy(), list(pdf["ctx"]), pdf["l"].to_numpy(np.int64), pdf["r"].to_numpy(np.int64), kind)
        if "lo" in pdf:
            d = np.arange(shared.shape[1]) * kind.width
            shared &= (d >= pdf["lo"].to_numpy()[:, None]) & (d < pdf["hi"].to_numpy()[:, None])
        row, a, b = _covered(shared, pdf["pos"].to_numpy(np.int64), kind)
        return pd.DataFrame({"k1": pdf["k1"].to_numpy()[row], "k2": pdf["k2"].to_numpy()[row], "a": a, "b": b})

    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) < SORTED:
            continue
        whole = pd.concat(held, ignore_index=True)
        g = whole["g"].to_numpy()
        cut = int(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))[-1])  # the last group may go on
        held = [whole.iloc[cut:]]
        if cut:
            yield work(whole.iloc[:cut])
    if held and len(whole := pd.concat(held, ignore_index=True)):
        yield work(whole)


# ---------------------------------------------------------------- plan

CONTEXT = ["g", "k1", "k2", "pos", "l", "r", "ctx", "hot"]


def _sorted(rows: DataFrame, kind: Strings) -> DataFrame:
    """Covered ranges (k1, k2, a, b) of contexts, by suffix sorts of whole groups ``g``."""
    alike = rows.repartition("g").sortWithinPartitions("g")
    return alike.mapInPandas(lambda it: _compared(it, kind), "k1 long, k2 long, a int, b int")


def _halved(hot: DataFrame, kind: Strings, group: int) -> DataFrame | None:
    """Covered ranges of contexts whose anchors have too many of them for one sort."""
    length, found, small = kind.length, None, None
    state = hot.select("*", F.lit(0).alias("lo"), F.lit(length - kind.gram + 1).alias("hi"))
    keys = ["lo", "hi", "i1", "i2"]
    while not state.isEmpty():
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
        rows = state.select(*hot.columns, F.explode(halves).alias("half")).select(*hot.columns, "half.lo", "half.hi")
        rows = rows.where((F.col("lo") < F.col("hi")) & (F.col("lo") <= F.col("l")) & (length + 1 - F.col("hi") <= F.col("r")))
        inner = F.substring("ctx", F.col("l") - F.col("lo") + 1, F.col("lo") + length + 1 - F.col("hi"))
        before, after = F.least(F.col("hi") - 1, F.col("l")), F.least(length - F.col("lo"), F.col("r"))
        outer = F.substring("ctx", F.col("l") - before + 1, before + after)
        rows = rows.select(
            "*",
            F.xxhash64("g", inner).alias("i1"),
            F.xxhash64(F.lit(1), inner, F.col("g")).alias("i2"),
            F.struct(F.xxhash64(before, outer).alias("u"), F.xxhash64(F.lit(1), outer, before).alias("v")).alias("u"),
        )
        many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1")).where("n > 1")
        many = stage(many.select(*keys, "n", (F.col("u0") == F.col("u1")).alias("even")))
        met = stage(rows.drop("u").join(many, keys))
        release(hot.sparkSession, many)
        done = F.col("even") | (F.col("hi") - F.col("lo") == 1)
        low, high = F.greatest(F.col("lo"), length - F.col("r")), F.least(F.col("hi") - 1, F.col("l"))
        ranges = met.where(done & (low <= high)).select("k1", "k2", (F.col("pos") - high).alias("a"), (F.col("pos") - low + length).alias("b"))
        found = ranges if found is None else found.unionByName(ranges)
        few = met.where(~done & (F.col("n") <= group)).select(F.col("i1").alias("g"), "k1", "k2", "pos", "l", "r", "ctx", "lo", "hi")
        small = few if small is None else small.unionByName(few)
        state = met.where(~done & (F.col("n") > group)).select(*hot.columns, "lo", "hi")
    return None if found is None else found.unionByName(_sorted(small, kind))


def keyed(df: DataFrame, id: str, text: str, k1: str = "k1", k2: str = "k2") -> DataFrame:
    """``df`` with k1, k2: rows equal in id and text have equal keys, and equal results."""
    return df.withColumns({k1: F.coalesce(F.xxhash64(F.col(id)), F.lit(0)), k2: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def repeats(docs: DataFrame, kind: Strings = BYTEWISE, group: int = GROUP) -> DataFrame:
    """Of ``docs`` (k1, k2, text), those with repeated strings: k1, k2 and ``spans``, unordered and overlapping ranges [a, b) of the strings' bytes."""
    spark, length = docs.sparkSession, kind.length
    text_batches(spark)
    docs = docs.select("k1", "k2", "text").where(F.octet_length("text") >= (length if kind.width == 1 else 2 * length // kind.width - 1))
    rows = "g long, c long, c2 long, k1 long, k2 long, pos int, l int, r int"
    every = stage(docs.mapInPandas(partial(_found, kind=kind), rows))
    many = stage(every.groupBy("g").count().where("count > 1").select("g"))
    found = stage(every.join(many, "g"))
    release(spark, every, many)
    rep, whole_key = F.min(F.struct("k1", "k2", "pos", "l", "r")), ["g", "c", "c2"]
    kinds = stage(found.groupBy(*whole_key).agg(F.count(F.lit(1)).alias("n"), rep.alias("rep")))
    twice = stage(kinds.where("n > 1").select(*whole_key))
    whole = found.where(F.col("l") + F.col("r") >= length).join(twice, whole_key)
    whole = stage(whole.select("k1", "k2", (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b")))
    several = stage(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    wanted = kinds.join(several, "g").select("g", "rep.*", (F.col("kinds") > group).alias("hot"))
    wanted = stage(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "pos", "l", "r", "hot")).alias("want")))
    release(spark, found, kinds, twice, several)
    schema = "g long, k1 long, k2 long, pos int, l int, r int, ctx binary, hot boolean"
    contexts = stage(docs.join(wanted, ["k1", "k2"]).mapInPandas(partial(_contexts, kind=kind), schema))
    release(spark, wanted)
    with batches_of(spark, 2000):
        ranges = whole.unionByName(_sorted(contexts.where("not hot").drop("hot"), kind))
        more = _halved(contexts.where("hot").drop("hot"), kind, group)
        if more is not None:
            ranges = ranges.unionByName(more)
        spans = stage(ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    release(spark, whole, contexts)
    return spans


def merge(spans) -> list[tuple[int, int]]:
    """Maximal runs from ranges (a, b) in any order."""
    out: list[list[int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, runs) -> bytes:
    """The text without maximal runs."""
    at, left = 0, []
    for a, b in runs:
        left.append(text[at:a])
        at = b
    return b"".join([*left, text[at:]])


def in_text(text: bytes, runs) -> list[tuple[int, int]]:
    """Byte ranges of the text from maximal runs of its words' codes, of ``WORDS`` whole words at least."""
    begin, end = word_places(text)
    whole = [(-(-a // 8), b // 8) for a, b in runs]
    return [(int(begin[a]), int(end[b - 1])) for a, b in whole if b - a >= WORDS]


CUT = "kept binary, less string, begins array<int>, ends array<int>"


def marked(own: DataFrame, k1: str, k2: str, text: str, into: str, length: int = LENGTH, group: int = GROUP, words: bool = False) -> DataFrame:
    """``own`` (with the keys k1, k2) and a column ``into``, null for rows that lose nothing: ``kept`` (binary), ``less`` (the same as
    text, a character cut in part goes whole) and the maximal runs ``begins``, ``ends`` that are gone. The rows' texts are shuffled once.

    ``words``: ``less`` is without windows of ``WORDS`` words as well as those of ``length`` bytes; the others go by bytes alone.
    """
    a, b, x, y = fresh(own, "a", "b", "x", "y")
    plain = own.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text).alias("text"))
    spans = repeats(plain, Strings(length=length), group)
    ranges = lambda spans, a, b: spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans.a").alias(a), F.col("spans.b").alias(b))
    full = own.join(ranges(spans, a, b), [k1, k2], "left")
    if words:
        full = full.join(ranges(repeats(plain, WORDWISE, group), x, y), [k1, k2], "left")
    else:
        full = full.withColumns({x: F.lit(None).cast("array<int>"), y: F.lit(None).cast("array<int>")})

    @F.pandas_udf(CUT)
    def made(texts: pd.Series, a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for text, *found in zip(texts, a, b, x, y, strict=True):
            a, b, x, y = ([] if v is None else v for v in found)
            t = (text or "").encode()
            runs = merge(zip(a, b, strict=True))
            kept = without(t, runs)
            both = without(t, merge([*runs, *in_text(t, merge(zip(x, y, strict=True)))])) if len(x) else kept
            rows.append((kept, both.decode(errors="ignore"), [r[0] for r in runs], [r[1] for r in runs]))
        return pd.DataFrame(rows, columns=["kept", "less", "begins", "ends"])

    some = F.col(a).isNotNull() | F.col(x).isNotNull()
    found = made(F.when(some, F.col(text)), a, b, x, y)
    return full.select(*own.columns, F.when(some, found).alias(into))


def cut(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """For each row of ``docs`` (k1, k2, text) that loses bytes: k1, k2 and what ``marked`` says of it."""
    found = marked(docs.select("k1", "k2", "text"), "k1", "k2", "text", "cut", length, group)
    return found.where("cut is not null").select("k1", "k2", "cut.*").dropDuplicates(["k1", "k2"])


def drop_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, words: bool = False) -> DataFrame:
    """All rows and columns of ``df``; from the text all repeated bytes are gone (a character cut in part goes whole)."""
    k1, k2, into = fresh(df, "k1", "k2", "cut")
    less = marked(keyed(df, id, text, k1, k2), k1, k2, text, into, length, words=words)
    return less.select(*[F.coalesce(F.col(into)["less"], F.col(text)).alias(c) if c == text else F.col(c) for c in df.columns])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Counts and digest by repeated strings of 400 bytes; ``text`` is the kept text, also without repeated passages of over 50 words that are shorter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone, text, zero = F.col("cut"), F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    removed = F.aggregate(F.zip_with(gone["ends"], gone["begins"], lambda b, a: (b - a).cast("long")), zero, lambda s, x: s + x)
    return marked(keyed(docs, "doc_id", "text"), "k1", "k2", "text", "cut", words=True).select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.coalesce(removed, zero).alias("n_removed"),
        F.coalesce(F.size(gone["begins"]).cast("long"), zero).alias("n_spans"),
        F.sha2(F.coalesce(gone["kept"], F.encode(text, "UTF-8")), 256).alias("kept_sha256"),
        F.coalesce(gone["less"], text).alias("text"),
    )


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by a table of all windows, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[gone[:-1] == 0])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
