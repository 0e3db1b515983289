"""Files that knowledge and indexes are read from and written to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.chunking import trim
from palaver.schemas import ACTION, ENTITY, EXPORT, TOPIC

RULE = "=" * 80
SHORTEST = 10
#: Messages, refs and postings that one JSON document may hold.
DOCUMENT_ROWS = 5_000_000
_VALUE = "array<struct<name:string,value:string>>"
KNOWLEDGE = (
    "entities array<struct<name:string,type:array<string>,facets:" + _VALUE + ">>,"
    "actions array<struct<verbs:array<string>,verbTense:string,subjectEntityName:string,objectEntityName:string,indirectObjectEntityName:string,params:" + _VALUE + ">>,"
    "inverseActions array<struct<verbs:array<string>>>,topics array<string>, _bad string"
)


def knowledge_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(knowledge, losses) from a file of sections divided by a rule: text, then one line of JSON.

    Short sections, and those without JSON, are left out; sections whose JSON can't be read are the losses.
    """
    sections = spark.read.option("lineSep", RULE).text(path).select(F.monotonically_increasing_id().alias("__at"), "value")
    at = F.instr("value", "{")
    rows = sections.select("__at", trim(F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise("")).alias("text"), F.when(at > 0, F.substring_index(F.substring("value", at, F.char_length("value")), "\n", 1)).alias("json"))
    rows = rows.where(F.char_length("text") >= SHORTEST).withColumn("k", F.from_json("json", KNOWLEDGE, {"columnNameOfCorruptRecord": "_bad"}))
    losses = rows.where("k._bad is not null or k is null").select("text", "json")
    good = rows.where("k._bad is null and k is not null")
    number = (F.row_number().over(Window.orderBy("__at")) - 1).cast("bigint")  # one file: a conversation of a person
    facets = lambda f: F.transform(f, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value_text")))
    entities = F.transform("k.entities", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), facets(e["facets"]).alias("facets")).cast(ENTITY))
    actions = F.transform(
        "k.actions",
        lambda a: F.struct(
            a["verbs"].alias("verbs"), a["verbTense"].alias("verb_tense"), a["subjectEntityName"].alias("subject"), a["objectEntityName"].alias("object"),
            a["indirectObjectEntityName"].alias("indirect_object"), facets(a["params"]).alias("params"), F.lit(None).cast("struct<name:string,value_text:string>").alias("subject_facet"),
        ).cast(ACTION),
    )
    topics = F.transform("k.topics", lambda t: F.struct(t.alias("text")).cast(TOPIC))
    knowledge = good.select(F.lit(0).cast("bigint").alias("conv_id"), number.alias("message_ordinal"), F.array("text").alias("text_chunks"), F.lit(None).cast("timestamp").alias("ts"), entities.alias("entities"), actions.alias("actions"), topics.alias("topics"))
    return knowledge, losses


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, refs, items) of an exported index; messages are numbered by their place."""
    whole = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    messages = whole.select(F.posexplode("messages").alias("message_ordinal", "m")).select(F.col("message_ordinal").cast("bigint").alias("message_ordinal"), F.array("m.content").alias("text_chunks"), F.try_to_timestamp("m.timestamp").alias("ts"))
    refs = whole.select(F.explode("semanticRefs").alias("r")).select(F.col("r.semanticRefOrdinal").alias("semantic_ref_ordinal"), F.col("r.messageOrdinal").alias("message_ordinal"), F.col("r.knowledgeType").alias("knowledge_type"), F.col("r.knowledge").alias("knowledge_json"))
    items = whole.select(F.posexplode("indexData.items").alias("item_pos", "i")).select("item_pos", "i.*")
    return messages, refs, items


def write_export(path: str, messages: DataFrame, refs: DataFrame, postings: DataFrame) -> None:
    """One JSON document, as people exchange it, made in one task; an index of over ``DOCUMENT_ROWS`` rows is refused and
    has to be written as tables (``write_tables``)."""
    rows = messages.count() + refs.count() + postings.count()
    if rows > DOCUMENT_ROWS:
        raise ValueError(f"{rows} rows are too many for one document; write_tables takes any number")
    posting = F.struct(F.col("semantic_ref_ordinal").alias("semanticRefOrdinal"), "score")
    items = postings.groupBy("term").agg(F.array_sort(F.collect_list(posting)).alias("semanticRefOrdinals"))
    items = items.agg(F.array_sort(F.collect_list(F.struct("term", "semanticRefOrdinals"))).alias("items"), F.count(F.lit(1)).alias("termCount"))
    ref = F.struct(F.col("semantic_ref_ordinal").alias("semanticRefOrdinal"), F.col("message_ordinal").alias("messageOrdinal"), F.col("knowledge_type").alias("knowledgeType"), F.col("knowledge_json").alias("knowledge"))
    listed = refs.agg(F.array_sort(F.collect_list(ref)).alias("semanticRefs"), F.count(F.lit(1)).alias("refCount"))
    message = F.struct(F.col("message_ordinal").alias("ordinal"), F.array_join("text_chunks", "").alias("content"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"))
    texts = messages.agg(F.array_sort(F.collect_list(message)).alias("messages"), F.count(F.lit(1)).alias("messageCount"))
    whole = items.crossJoin(listed).crossJoin(texts)  # single rows
    whole.select(F.struct("items").alias("indexData"), "semanticRefs", "messages", F.struct("termCount", "refCount", "messageCount").alias("stats")).coalesce(1).write.json(path)


def write_tables(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_chunks(path: str, chunks: DataFrame, config: dict) -> None:
    chunks.write.json(f"{path}/chunks")
    chunks.sparkSession.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{path}/config")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    from palaver.schemas import CHUNKS

    config = json.loads(spark.read.text(f"{path}/config").head()[0])
    return spark.read.schema(CHUNKS).json(f"{path}/chunks"), config


class Storage:
    """Tables of conversations under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def load_file(self, path: str) -> tuple[DataFrame, DataFrame]:
        return knowledge_file(self.spark, path)
