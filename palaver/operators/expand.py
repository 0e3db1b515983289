"""Postings for lemmas, synonyms and other related terms, from a table of relations (term, related, relation, rank).

Each pass looks at the index as it was before the pass (one hop); ``hops`` repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are never expanded.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need "
    "dare ought used to of in for on with at by from as into through during before after above below between under again "
    "further then once here there when where why how all each few more most other some such no nor not only own same so "
    "than too very just and but if or because until while this that these those it its"
).split()
WEIGHT = 0.9
MOST_SYNONYMS = 5


def eligible(term: Column, stop_words: bool = True) -> Column:
    fits = (F.char_length(term) >= 3) & (F.instr(term, " ") == 0)
    return fits & ~term.isin(*STOP_WORDS) if stop_words else fits


def relations(postings: DataFrame, table: DataFrame, kind: str, most: int | None = None, max_terms: int | None = None) -> DataFrame:
    """(term, related): the relations of ``kind`` that apply to the index's terms."""
    own = postings.groupBy("term").agg(F.min("semantic_ref_ordinal").alias("first")).where(eligible(F.col("term"), kind != "lemma"))
    if max_terms is not None:
        own = own.orderBy("first", "term").limit(max_terms)
    wanted = table.where((F.col("relation") == kind) & (F.col("term") != F.col("related")))
    if most is not None:
        wanted = wanted.where(F.col("rank") <= most)
    if kind == "synonym":
        wanted = wanted.withColumn("related", F.lower(F.replace("related", F.lit("_"), F.lit(" ")))).where(F.instr("related", " ") == 0)
    return own.join(wanted, "term").select("term", "related").distinct()


def expand(postings: DataFrame, table: DataFrame, kind: str, weight: float = WEIGHT, most: int | None = None, max_terms: int | None = None, hops: int = 1) -> DataFrame:
    """The index with postings (related, ref, score times weight) where term and ref aren't there yet."""
    for _ in range(hops):
        more = postings.join(relations(postings, table, kind, most, max_terms), "term")
        more = more.groupBy("conv_id", F.lower("related").alias("term"), "semantic_ref_ordinal").agg((F.max("score") * weight).alias("score"))
        new = more.join(postings, ["conv_id", "term", "semantic_ref_ordinal"], "left_anti")
        postings = postings.unionByName(new)
    return postings


def lemmatize(postings: DataFrame, table: DataFrame) -> DataFrame:
    return expand(postings, table, "lemma", weight=1.0)


def with_synonyms(postings: DataFrame, table: DataFrame, weight: float = WEIGHT, max_terms: int | None = None) -> DataFrame:
    return expand(postings, table, "synonym", weight, MOST_SYNONYMS, max_terms)


def with_related(postings: DataFrame, table: DataFrame, weight: float = WEIGHT, max_terms: int | None = None) -> DataFrame:
    return expand(postings, table, "llm", weight, None, max_terms)


def statistics(postings: DataFrame, table: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """For each expanded term its related terms, sorted, and their number."""
    found = relations(postings, table, kind, most).groupBy("term").agg(F.sort_array(F.collect_set("related")).alias("related"))
    return found.select("term", F.array_join("related", ",").alias("related"), F.size("related").cast("bigint").alias("n_related"))
