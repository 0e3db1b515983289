"""From messages with knowledge to semantic refs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.schemas import ACTION, ENTITY, FACET, TOPIC

#: Messages whose ordinals are summed by one window; buckets are summed among themselves.
BUCKET = 100_000


def ordinals(df: DataFrame, by: str, count: Column, name: str, base: int = 0) -> DataFrame:
    """``df`` with ``name``: the sum of ``count`` over all rows before in order of the dense integer ``by``, from ``base``.

    Sums run within buckets of ``by`` and over the buckets' totals, so no task orders the whole table.
    """
    rows = df.withColumn("__n", count.cast("bigint")).withColumn("__bucket", F.floor(F.col(by) / BUCKET))
    totals = rows.groupBy("__bucket").agg(F.sum("__n").alias("__all"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__bucket", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    return rows.join(totals, "__bucket").withColumn(name, F.col("__base") + F.col("__own") + base).drop("__n", "__bucket", "__own", "__base")


def merge_inverse(knowledge: DataFrame, inverse: str = "inverse_actions") -> DataFrame:
    """Actions followed by inverse actions; these are emptied."""
    none = F.array().cast(f"array<{ACTION}>")
    return knowledge.withColumn("actions", F.concat(F.coalesce("actions", none), F.coalesce(inverse, none))).withColumn(inverse, none)


def merge_facets(knowledge: DataFrame, dedup: bool = False) -> DataFrame:
    """A subject's facet goes to the first entity of exactly that name, and leaves the action even where no entity has it."""
    names = F.transform("entities", lambda e: e["name"])

    def added(e: Column, k: Column) -> Column:
        own = F.filter("actions", lambda a: a["subject_facet"].isNotNull() & (a["subject"] == e["name"]))
        facets = F.transform(own, lambda a: a["subject_facet"])
        first = F.array_position(names, e["name"]) == k + 1
        both = F.concat(F.coalesce(e["facets"], F.array().cast(f"array<{FACET}>")), F.when(first, facets).otherwise(F.array().cast(f"array<{FACET}>")))
        return F.struct(e["name"].alias("name"), e["type"].alias("type"), (F.array_distinct(both) if dedup else both).alias("facets")).cast(ENTITY)

    cleared = F.transform("actions", lambda a: a.withField("subject_facet", F.lit(None).cast(FACET)))
    return knowledge.withColumns({"entities": F.transform("entities", added), "actions": cleared})


def entity_json(e: Column) -> Column:
    facets = F.transform(e["facets"], lambda f: F.struct(f["name"].alias("name"), f["value_text"].alias("value")))
    return F.to_json(F.struct(e["name"].alias("name"), e["type"].alias("type"), F.when(F.size(facets) > 0, facets).alias("facets")))


def action_json(a: Column) -> Column:
    params = F.transform(a["params"], lambda f: F.struct(f["name"].alias("name"), f["value_text"].alias("value")))
    return F.to_json(
        F.struct(
            a["verbs"].alias("verbs"),
            a["verb_tense"].alias("verbTense"),
            a["subject"].alias("subjectEntityName"),
            a["object"].alias("objectEntityName"),
            a["indirect_object"].alias("indirectObjectEntityName"),
            F.when(F.size(params) > 0, params).alias("params"),
        )
    )


def populate(knowledge: DataFrame, base: int = 0) -> DataFrame:
    """Semantic refs: of each message its entities, then actions, then topics, with ordinals that run on from message to message.

    A message without an actions list keeps its entities and loses its topics, as a list that is missing ends it.
    """
    none = lambda kind: F.lit(None).cast(kind)

    def row(kind: str, e: Column, a: Column, t: Column, json: Column) -> Column:
        return F.struct(F.lit(kind).alias("knowledge_type"), e.alias("entity"), a.alias("action"), t.alias("topic"), json.alias("knowledge_json"))

    empty = F.array().cast(f"array<struct<knowledge_type:string,entity:{ENTITY},action:{ACTION},topic:{TOPIC},knowledge_json:string>>")
    entities = F.coalesce(F.transform("entities", lambda e: row("entity", e, none(ACTION), none(TOPIC), entity_json(e))), empty)
    actions = F.coalesce(F.transform("actions", lambda a: row("action", none(ENTITY), a, none(TOPIC), action_json(a))), empty)
    topics = F.when(F.col("actions").isNotNull(), F.transform("topics", lambda t: row("topic", none(ENTITY), none(ACTION), t, F.to_json(t))))
    rows = knowledge.select("conv_id", "message_ordinal", F.concat(entities, actions, F.coalesce(topics, empty)).alias("refs"))
    numbered = ordinals(rows, "message_ordinal", F.size("refs"), "__first", base)
    out = numbered.select("conv_id", "message_ordinal", "__first", F.posexplode("refs").alias("__pos", "ref"))
    return out.select("conv_id", (F.col("__first") + F.col("__pos")).alias("semantic_ref_ordinal"), "message_ordinal", "ref.*")


def topics_of(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("knowledge_type") == "topic")
