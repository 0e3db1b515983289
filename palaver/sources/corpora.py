"""Messages and knowledge made from the driver's tables, one definition for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.schemas import ACTION, ENTITY, FACET, TOPIC


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; timestamps without a zone are taken as UTC. Any path that Spark can open will do."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def facet(name: Column | str, value: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("string").alias("value_text"))


def entity(name: Column, types: list[Column], facets: list[Column]) -> Column:
    return F.struct(name.alias("name"), F.array(*types).alias("type"), (F.array(*facets) if facets else F.array()).cast(f"array<{FACET}>").alias("facets")).cast(ENTITY)


def action(verbs: list[Column], tense: str, subject: Column, obj: Column, indirect: Column, params: list[Column]) -> Column:
    return F.struct(
        F.array(*verbs).alias("verbs"),
        F.lit(tense).alias("verb_tense"),
        subject.alias("subject"),
        obj.alias("object"),
        indirect.alias("indirect_object"),
        (F.array(*params) if params else F.array()).cast(f"array<{FACET}>").alias("params"),
        F.lit(None).cast(FACET).alias("subject_facet"),
    ).cast(ACTION)


def topic(text: Column) -> Column:
    return F.struct(text.alias("text")).cast(TOPIC)


def order_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each order, with its entities, actions and topics."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey").cast("string")
    return joined.select(
        F.lit(0).cast("bigint").alias("conv_id"),
        F.col("o_orderkey").alias("message_ordinal"),
        F.array(F.concat("c_name", F.lit(" placed order "), key)).alias("text_chunks"),
        F.col("o_orderdate").alias("ts"),
        F.array(entity(F.col("c_name"), [F.lower("c_mktsegment"), F.lit("customer")], [facet("nation", F.col("n_name"))])).alias("entities"),
        F.array(
            action(
                [F.lit("place")], "past", F.col("c_name"), F.concat(F.lit("order "), key), F.lit("none"),
                [facet("priority", F.col("o_orderpriority")), facet("status", F.col("o_orderstatus"))],
            )
        ).alias("actions"),
        F.array(topic(F.concat(F.lower("o_orderpriority"), F.lit(" order")))).alias("topics"),
    )


def event_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each event: its user and what they did."""
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select(
        F.lit(0).cast("bigint").alias("conv_id"),
        F.col("event_id").alias("message_ordinal"),
        F.array(F.concat(user, F.lit(" "), F.col("event_type"))).alias("text_chunks"),
        "ts",
        F.array(entity(user, [F.lit("user")], [])).alias("entities"),
        F.array(action([F.col("event_type")], "past", user, F.lit("none"), F.lit("none"), [facet("k", F.get_json_object("props", "$.k"))])).alias("actions"),
        F.array().cast(f"array<{TOPIC}>").alias("topics"),
    )


def turn_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each conversation turn; its longer words are its topics. No timestamps."""
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.char_length(w) >= 6))
    return read(spark, sf_dir, "conversations").select(
        "conv_id",
        F.col("turn").alias("message_ordinal"),
        F.array("text").alias("text_chunks"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.array().cast(f"array<{ENTITY}>").alias("entities"),
        F.array().cast(f"array<{ACTION}>").alias("actions"),
        F.transform(tokens, topic).alias("topics"),
    )


def messages(knowledge: DataFrame) -> DataFrame:
    return knowledge.select("conv_id", "message_ordinal", "text_chunks", "ts")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as chunks."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("chunk_pos"),
        F.concat(F.lit("chunk-"), F.col("vec_id").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("text"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
