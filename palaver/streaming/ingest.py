"""Keeping the index up to date from a stream of messages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import ingest, postings, store
from palaver import providers
from palaver.functions import chunking
from palaver.sources import corpora


def event_postings(events: DataFrame) -> DataFrame:
    """(message_ordinal, knowledge_type, term) of a batch of events; the same rows for the same events, in whatever batch."""
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    k = F.get_json_object("props", "$.k")
    rows = events.select(
        F.lit(0).cast("bigint").alias("conv_id"),
        F.col("event_id").alias("message_ordinal"),
        F.array(corpora.entity(user, [F.lit("user")], [])).alias("entities"),
        F.array(corpora.action([F.col("event_type")], "past", user, F.lit("none"), F.lit("none"), [corpora.facet("k", k)])).alias("actions"),
    )
    parts = F.array(
        F.struct(F.lit("entity").alias("kind"), postings.entity_terms(F.col("entities")[0]).alias("terms")),
        F.struct(F.lit("action").alias("kind"), postings.action_terms(F.col("actions")[0]).alias("terms")),
    )
    each = rows.select("message_ordinal", F.explode(parts).alias("p")).select("message_ordinal", F.col("p.kind").alias("knowledge_type"), F.explode("p.terms").alias("term"))
    return each.where(F.col("term").isNotNull() & (F.col("term") != "")).withColumn("term", F.lower("term")).distinct()


def append_batches(stream: DataFrame, build, out: str, checkpoint: str):
    """Start a query that appends ``build(batch)`` to ``out``, one folder a batch: a batch that is done again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the events table, read as a stream of files and appended batch by batch."""
    base = f"{store.folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/[e]vents.parquet")
    append_batches(stream, event_postings, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("message_ordinal", "knowledge_type", "term").distinct()


def stream_chunks(spark: SparkSession, sf_dir: str, size: int, overlap: int, embed=providers.hashed, batch: int = 100) -> DataFrame:
    """Chunks of the documents with their embeddings, read as a stream of files; each batch is cut, embedded and appended."""
    base = f"{store.folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/[d]ocuments.parquet")
    append_batches(stream, lambda rows: providers.embed(chunking.fixed(rows, size, overlap), embed, batch), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def stream_sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of ``events`` (user_id, ts) read back as a stream of files in ``parts``, in order of time but for the tenth that
    comes one file late. A row beyond the watermark closes what is open."""
    spark = events.sparkSession
    base = f"{store.folder(spark)}/stream-{uuid.uuid4().hex}"
    parts = 4
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()[0]
    end = F.lit(span["b"])
    place = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(span["a"]))) * parts / (F.unix_micros(end) - F.unix_micros(F.lit(span["a"])) + 1))
    within = F.unix_micros("ts") % 10 == 0  # comes late, but not too late
    rows = events.select("user_id", "ts", F.when(within, F.least(place + 1, F.lit(parts - 1))).otherwise(place).cast("int").alias("part"))
    for k in range(parts):
        rows.where(F.col("part") == k).select("user_id", "ts").coalesce(1).write.mode("append").parquet(f"{base}/in")
    last = spark.range(1).select(F.lit(None).cast(dict(events.dtypes)["user_id"]).alias("user_id"), (end + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    for k in (1, 2):
        last.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {k} DAYS")).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    done = sessions(stream, gap, f"{(span['b'] - span['a']).days + 1} days" if late is None else late)
    run = done.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{base}/out").where("user_id is not null")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(user_id, begin, end, n) by session windows; on a stream, with a watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    groups = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return groups.select("user_id", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def next_ordinals(stream: DataFrame, key: str = "conv_id") -> DataFrame:
    """A stream's rows (key, text) with ``message_ordinal``, counted per key across batches and restarts in state."""

    def number(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            out = pd.DataFrame({key: k[0], "text": pdf["text"].to_numpy(), "message_ordinal": range(n, n + len(pdf))})
            n += len(pdf)
            yield out
        state.update((n,))

    return stream.groupBy(key).applyInPandasWithState(number, f"{key} bigint, text string, message_ordinal bigint", "n bigint", "append", "NoTimeout")


def refs_of_batch(knowledge: DataFrame, base: int) -> DataFrame:
    return ingest.populate(knowledge, base)
