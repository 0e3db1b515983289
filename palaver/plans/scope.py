"""Boolean term groups, properties, scopes and fuzzy terms: the contract that queries declare."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators import store


def any_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Refs with any of the terms: number of terms met, summed score, the terms."""
    hits = postings.where(F.col("term").isin(*terms))
    return hits.groupBy("conv_id", "semantic_ref_ordinal").agg(F.count_distinct("term").alias("n_terms"), F.sum("score").alias("score"), F.sort_array(F.collect_set("term")).alias("terms"))


def all_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    return any_of(postings, terms).where(F.col("n_terms") == len(set(terms)))


def most_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Refs that meet as many of the terms as any ref does."""
    hits = store.written(any_of(postings, terms))  # read twice
    best = hits.agg(F.max("n_terms").alias("n_terms"))
    return hits.join(F.broadcast(best), "n_terms")  # one row


@dataclass(frozen=True)
class Group:
    """``op`` over terms and further groups: "and", "or" or "or_max"."""

    op: str
    parts: tuple[str | Group, ...]


def search(postings: DataFrame, group: Group) -> DataFrame:
    """(conv_id, semantic_ref_ordinal, n_terms, score): parts met, and their summed scores, by nested groups."""
    found = None
    for part in group.parts:
        if isinstance(part, Group):
            hits = search(postings, part).select("conv_id", "semantic_ref_ordinal", "score")
        else:
            hits = postings.where(F.col("term") == part.lower()).groupBy("conv_id", "semantic_ref_ordinal").agg(F.max("score").alias("score"))
        found = hits if found is None else found.unionByName(hits)
    sums = found.groupBy("conv_id", "semantic_ref_ordinal").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("score").alias("score"))
    if group.op == "and":
        return sums.where(F.col("n_terms") == len(group.parts))
    if group.op == "or_max":
        return sums.join(F.broadcast(sums.agg(F.max("n_terms").alias("n_terms"))), "n_terms").select(*sums.columns)
    return sums


def properties(refs: DataFrame) -> DataFrame:
    """(conv_id, name, value, ref): names, types, verbs, subjects, objects, topics and facets of the refs, lower case."""
    pair = lambda name, value: F.struct(F.lower(name if not isinstance(name, str) else F.lit(name)).alias("name"), F.lower(value).alias("value"))
    e, a, t = F.col("entity"), F.col("action"), F.col("topic")
    kind = "array<struct<name:string,value:string>>"
    of_entity = F.concat(F.array(pair("name", e["name"])), F.transform(e["type"], lambda x: pair("type", x)), F.transform(e["facets"], lambda f: pair(f["name"], f["value_text"])))
    of_action = F.concat(F.transform(a["verbs"], lambda v: pair("verb", v)), F.array(pair("subject", a["subject"]), pair("object", a["object"]), pair("indirectObject", a["indirect_object"])))
    of_topic = F.array(pair("topic", t["text"]))
    k = F.col("knowledge_type")
    pairs = F.when(k == "entity", of_entity.cast(kind)).when(k == "action", of_action.cast(kind)).when(k == "topic", of_topic.cast(kind))
    return refs.select("conv_id", "semantic_ref_ordinal", F.explode(pairs).alias("p")).select("conv_id", "p.name", "p.value", "semantic_ref_ordinal").where("value is not null")


def with_property(table: DataFrame, name: str, value: str) -> DataFrame:
    """Refs with a property of this value; ``*`` is any value."""
    same = F.lit(True) if value == "*" else F.col("value") == value.lower()
    return table.where((F.col("name") == name.lower()) & same).select("conv_id", "semantic_ref_ordinal").distinct()


@dataclass(frozen=True)
class SearchTerm:
    """A term with its weight. ``related``: further terms with weights; empty for none, None for those that the relation table has."""

    term: str
    weight: float = 1.0
    related: tuple[tuple[str, float], ...] | None = ()


def search_terms(postings: DataFrame, asked: list[SearchTerm], table: DataFrame | None = None, weight: float = 0.9) -> DataFrame:
    """(conv_id, semantic_ref_ordinal, n_terms, score): terms met by themselves or by a related term; each counts with the best of its scores."""
    spark = postings.sparkSession
    pairs = [(a.term.lower(), a.term.lower(), a.weight) for a in asked]
    pairs += [(a.term.lower(), t.lower(), w) for a in asked for t, w in a.related or ()]
    rows = spark.createDataFrame(pairs, "asked string, term string, weight double")
    looked = [a.term.lower() for a in asked if a.related is None]
    if table is not None and looked:
        own = F.coalesce(*[F.when(F.col("term") == a.term.lower(), F.lit(float(a.weight))) for a in asked])
        rows = rows.unionByName(table.where(F.col("term").isin(*looked)).select(F.col("term").alias("asked"), F.lower("related").alias("term"), (own * weight).alias("weight")))
    hits = postings.join(rows, "term").groupBy("conv_id", "semantic_ref_ordinal", "asked").agg(F.max(F.col("score") * F.col("weight")).alias("score"))
    return hits.groupBy("conv_id", "semantic_ref_ordinal").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("score").alias("score"))


@dataclass(frozen=True)
class When:
    """All that is given must hold. ``ranges`` are half-open; ``tags``: any of the message's; ``within``: messages that a search group finds."""

    knowledge_type: str | None = None
    date_range: tuple[datetime, datetime] | None = None
    scope_terms: tuple[str, ...] = ()
    messages: tuple[int, int] | None = None
    ranges: tuple[tuple[int, int], ...] = ()
    tags: tuple[str, ...] = ()
    within: Group | None = None


def thread_ranges(found: DataFrame) -> tuple[tuple[int, int], ...]:
    """Ranges of threads (begin, end inclusive) that a description found: a short list by its k."""
    return tuple((r["begin"], r["end"] + 1) for r in found.select("begin", "end").collect())


def apply(hits: DataFrame, refs: DataFrame, messages: DataFrame, postings: DataFrame, when: When) -> DataFrame:
    own = refs.select("conv_id", "semantic_ref_ordinal", "message_ordinal", "knowledge_type")
    if when.knowledge_type:
        own = own.where(F.col("knowledge_type") == when.knowledge_type)
    if when.messages:
        own = own.where(F.col("message_ordinal").between(*when.messages))
    key = ["conv_id", "message_ordinal"]
    if when.date_range:
        own = own.join(messages.where(F.col("ts").between(*[F.lit(x) for x in when.date_range])).select(*key), key, "left_semi")
    if when.ranges:
        m = F.col("message_ordinal")
        own = own.where(reduce(lambda x, y: x | y, [(m >= a) & (m < b) for a, b in when.ranges]))
    if when.tags:
        own = own.join(messages.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in when.tags]))).select(*key), key, "left_semi")
    if when.within:
        there = search(postings, when.within).join(refs, ["conv_id", "semantic_ref_ordinal"]).select(*key)
        own = own.join(there, key, "left_semi")
    if when.scope_terms:
        there = any_of(postings, list(when.scope_terms)).join(refs, ["conv_id", "semantic_ref_ordinal"]).select(*key)
        own = own.join(there, key, "left_semi")
    return hits.join(own.select("conv_id", "semantic_ref_ordinal"), ["conv_id", "semantic_ref_ordinal"])


def related(asked: list[str], table: DataFrame, most: int | None = None) -> DataFrame:
    """Aliases of the asked terms from the relation table."""
    found = table.where(F.col("term").isin(*asked))
    return found if most is None else found.where(F.col("rank") <= most)


def fuzzy(postings: DataFrame, asked: list[str], most: int = 5, distance: int = 2) -> DataFrame:
    """(asked, term, distance): the index's terms within an edit distance, the nearest ``most`` of each asked term."""
    terms = postings.select("term").distinct()
    each = F.explode(F.array(*[F.lit(a) for a in asked])).alias("asked")  # a stated list against all terms
    near = terms.select("term", each).withColumn("distance", F.levenshtein("asked", "term")).where(F.col("distance") <= distance)
    n = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "term"))
    return near.withColumn("n", n).where(F.col("n") <= most).select("asked", "term", "distance")
