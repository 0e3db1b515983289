"""Cutting text into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = r"[^.!?]+[.!?]+"
BLANK = r"^\s+|\s+$"


def check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Fixed windows over a text, each ``overlap`` characters into the one before; the last reaches the end."""
    check(size, overlap)
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.char_length(text) - size) / F.lit(step))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.char_length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def fixed(df: DataFrame, size: int, overlap: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk, text): texts up to the size whole and as they are, others in trimmed windows; empty ones drop out, numbers stay."""
    short = F.char_length(text) <= size
    cut = F.when(short & (F.char_length(text) > 0), F.array(F.col(text))).otherwise(F.transform(windows(F.col(text), size, overlap), trim))
    rows = df.select(id, F.posexplode(cut).alias("chunk", "text"))
    return rows.where(F.col("text") != "").withColumn("chunk", F.col("chunk").cast("bigint"))


def by_sentence(text: str | None, size: int, overlap: int = 0, keep_tail: bool = False) -> list[str]:
    """Sentences packed greedily; one longer than a chunk is cut into windows; what follows the last full stop is lost unless kept."""
    check(size, overlap)
    if not text:
        return []
    if len(text) <= size:
        return [text]
    found = re.findall(SENTENCE, text) or [text]
    if keep_tail and len(tail := text[sum(map(len, found)) :]):
        found.append(tail)
    out, held = [], ""
    for s in found:
        if len(held) + len(s) <= size:
            held += s
            continue
        if held:
            out.append(held)
        held = s
        if len(s) > size:
            step = size - overlap
            out += [s[a : a + size] for a in range(0, max(1, len(s) - overlap), step)]
            held = ""
    return [*out, *([held] if held else [])]


def packed(df: DataFrame, size: int, overlap: int = 0, id: str = "doc_id", text: str = "text", keep_tail: bool = False) -> DataFrame:
    """(id, chunk, text) by sentences, in batches."""
    check(size, overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c.strip() if len(t) > size else c) for i, t in zip(pdf[id], pdf[text], strict=True) for k, c in enumerate(by_sentence(t, size, overlap, keep_tail))]
            yield pd.DataFrame([r for r in rows if r[2]], columns=[id, "chunk", "text"])

    return df.select(id, text).mapInPandas(run, f"{id} {dict(df.dtypes)[id]}, chunk bigint, text string")
