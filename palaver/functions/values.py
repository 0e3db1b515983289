"""Small rules on values: comparison, clamping, objects as maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters compare without case and accents.
PLAIN = "UNICODE_CI_AI"


def same_name(a: Column, b: Column) -> Column:
    """Equal but for case and accents; null equals nothing."""
    return F.collate(a, PLAIN) == F.collate(b, PLAIN)


def same_facet(a: Column, b: Column) -> Column:
    """Facets of like names and of the same value."""
    return same_name(a["name"], b["name"]) & a["value_text"].eqNullSafe(b["value_text"])


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def merged(base: Column, over: Column) -> Column:
    """Both maps' entries; those of ``over`` win."""
    mine = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.map_concat(mine, over)


def with_entry(m: Column, key: str, value: Column) -> Column:
    return merged(m, F.create_map(F.lit(key), value))


def any_of(text: Column, parts: list[str]) -> Column:
    """Does the text hold any of the parts?"""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def serialized(value: Column) -> Column:
    return F.to_json(value)


def deserialized(json: Column, schema: str) -> Column:
    return F.from_json(json, schema)


def fits(json: Column, schema: str, required: tuple[str, ...] = ()) -> Column:
    """Is the text JSON of this schema, with the required fields present?"""
    read = F.from_json(json, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = read.isNotNull() & read["_bad"].isNull()
    for name in required:
        good = good & read[name].isNotNull()
    return F.coalesce(good, F.lit(False))
