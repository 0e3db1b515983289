"""The inverted index: terms and the semantic refs they occur in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_KEY = ("conv_id", "term", "semantic_ref_ordinal")


def facet_terms(facets: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(facets, F.array().cast("array<struct<name:string,value_text:string>>")), lambda f: F.array(f["name"], F.when(~f["value_text"].isin("0", "false"), f["value_text"]))))


def entity_terms(e: Column) -> Column:
    """Name, types, facets; nothing of an entity without types."""
    return F.when(e["type"].isNotNull(), F.concat(F.array(e["name"]), e["type"], facet_terms(e["facets"])))


def action_terms(a: Column) -> Column:
    """The verbs as one term, object, indirect object, subject, parameters."""
    return F.concat(F.array(F.array_join(a["verbs"], " "), a["object"], a["indirect_object"], a["subject"]), facet_terms(a["params"]))


def topic_terms(t: Column) -> Column:
    return F.array(t["text"])


def of(refs: DataFrame, kinds: tuple[str, ...] = ("entity", "action", "topic")) -> DataFrame:
    """Postings of the refs: a set over term and ref. Terms are lower case; empty ones don't count.

    Everything happens within a row, so building an index shuffles nothing.
    """
    by_kind = {"entity": entity_terms(F.col("entity")), "action": action_terms(F.col("action")), "topic": topic_terms(F.col("topic"))}
    terms = F.array().cast("array<string>")
    for kind in kinds:
        terms = F.when(F.col("knowledge_type") == kind, by_kind[kind]).otherwise(terms)
    own = F.array_distinct(F.transform(F.filter(terms, lambda t: t.isNotNull() & (t != "")), F.lower))
    return refs.where(F.col("knowledge_type").isin(*kinds)).select("conv_id", F.explode(own).alias("term"), "semantic_ref_ordinal", F.lit(1.0).alias("score"))


def terms(postings: DataFrame) -> DataFrame:
    """Terms and the ref in which each first occurs."""
    return postings.groupBy("term").agg(F.min("semantic_ref_ordinal").alias("first_ref"))


def lookup(postings: DataFrame, term: str) -> DataFrame:
    """The argument is taken as it is; the index holds lower case."""
    return postings.where(F.col("term") == term)


def remove(postings: DataFrame, term: str, ordinal: int | None = None) -> DataFrame:
    gone = F.col("term") == term
    return postings.where(~(gone if ordinal is None else gone & (F.col("semantic_ref_ordinal") == ordinal)))


def load(items: DataFrame) -> DataFrame:
    """Postings from exported items (item_pos, term, semanticRefOrdinals): of items equal in lower case the last counts."""
    last = items.groupBy(F.lower("term").alias("term")).agg(F.max_by("semanticRefOrdinals", "item_pos").alias("refs"))
    return last.select("term", F.explode("refs").alias("r")).select("term", F.col("r.semanticRefOrdinal").alias("semantic_ref_ordinal"), F.col("r.score").alias("score"))
