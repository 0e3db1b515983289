"""A chunk index: texts in, embedded chunks kept as a table, nearest chunks out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver import providers
from palaver.functions import chunking
from palaver.operators import vector_index
from palaver.operators.ingest import ordinals
from palaver.schemas import CHUNKS
from palaver.sources import documents


def from_texts(df: DataFrame, size: int, overlap: int = 0, sentences: bool = True, text: str = "text", by: str = "pos", prefix: str = "text") -> DataFrame:
    """(by, chunk, id, text): chunks of each row's text, named by a prefix, the row's place and the chunk's."""
    cut = chunking.packed(df, size, overlap, by, text) if sentences else chunking.fixed(df, size, overlap, by, text)
    return cut.select(by, "chunk", F.concat_ws("-", F.lit(prefix), F.col(by).cast("string"), F.col("chunk").cast("string")).alias("id"), "text")


def from_messages(messages: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """(message_ordinal, id, text, metadata): each text chunk of each message; given metadata come over the message's own."""
    rows = messages.select("message_ordinal", F.posexplode("text_chunks").alias("chunk", "text"))
    own = {"messageOrdinal": F.col("message_ordinal").cast("string")} | {k: F.lit(v) for k, v in (extra or {}).items()}
    meta = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    name = F.concat_ws("-", F.lit("msg"), F.col("message_ordinal").cast("string"), F.col("chunk").cast("string"))
    return rows.select("message_ordinal", "chunk", name.alias("id"), "text", meta.alias("metadata"))


#: More chunks than one text can have: an array holds no more.
CHUNKS_MOST = 1 << 31


class RagIndex:
    """Chunks under a path of the shared storage; each addition is appended, so positions never shift.

    What is removed is written down with the number of the additions before it, so an id that is added again counts again.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable = providers.hashed, batch: int = 100, size: int = 1000, overlap: int = 100):
        self.spark, self.path, self.embed, self.batch, self.size_, self.overlap = spark, path.rstrip("/"), embed, batch, size, overlap
        self.writes, self.removals = 0, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, **settings) -> RagIndex:
        """An index saved by ``save``: its embeddings are taken over, nothing is embedded again."""
        chunks, config = documents.read_chunks(spark, path)
        index = cls(spark, f"{path.rstrip('/')}/opened-{uuid.uuid4().hex}", batch=config["batchSize"], size=config["chunkSize"], overlap=config["overlap"], **settings)
        chunks.write.parquet(f"{index.path}/0")
        index.writes = 1
        return index

    def chunks(self) -> DataFrame:
        if not self.writes:
            return self.spark.createDataFrame([], CHUNKS)
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{k}").withColumn("__write", F.lit(k)) for k in range(self.writes)])
        if self.removals:
            gone = self.spark.read.parquet(*[f"{self.path}/gone-{k}" for k in range(self.removals)])
            gone = gone.groupBy("id").agg(F.max("writes").alias("__writes"))
            rows = rows.join(gone, "id", "left").where("__writes is null or __write >= __writes").drop("__writes")
        return rows.select("chunk_pos", "id", "text", "metadata", "embedding")

    def size(self) -> int:
        return self.chunks().count()

    def add_chunks(self, df: DataFrame, order: str = "pos") -> None:
        """Rows (order, id, text, metadata) with a dense integer order; embedded in batches on the executors."""
        base = 0
        if self.writes:
            base = self.spark.read.parquet(*[f"{self.path}/{k}" for k in range(self.writes)]).agg(F.max("chunk_pos").alias("n")).collect()[0]["n"]
            base = 0 if base is None else base + 1
        placed = ordinals(df, order, F.lit(1), "chunk_pos", base)
        if "metadata" not in df.columns:
            placed = placed.withColumn("metadata", F.create_map().cast("map<string,string>"))
        embedded = providers.embed(placed.select("chunk_pos", "id", "text", "metadata"), self.embed, self.batch)
        embedded.write.parquet(f"{self.path}/{self.writes}")
        self.writes += 1

    def add_texts(self, texts: list[str], prefix: str = "text") -> None:
        df = self.spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
        cut = from_texts(df, self.size_, self.overlap, prefix=prefix)
        self.add_chunks(cut.withColumn("pos", F.col("pos") * CHUNKS_MOST + F.col("chunk")))

    def add_messages(self, messages: DataFrame, extra: dict[str, str] | None = None) -> None:
        rows = from_messages(messages, extra)
        self.add_chunks(rows.withColumn("pos", F.col("message_ordinal") * CHUNKS_MOST + F.col("chunk")))

    def query(self, text: str, k: int = 5, least: float = 0.0, where: Column | None = None) -> DataFrame:
        return vector_index.query(self.chunks(), self.embed([text])[0].tolist(), k, least, where)

    def query_many(self, texts: list[str], k: int = 5, least: float = 0.0, where: Column | None = None) -> DataFrame:
        return vector_index.query_many(self.chunks(), self.embed(texts).tolist(), k, least, where)

    def remove(self, ids: list[str]) -> int:
        _, n = vector_index.remove(self.chunks(), ids)
        if ids:
            self.spark.createDataFrame([(i, self.writes) for i in ids], "id string, writes int").write.parquet(f"{self.path}/gone-{self.removals}")
            self.removals += 1
        return n

    def clear(self) -> None:
        self.writes, self.removals, self.path = 0, 0, f"{self.path}-cleared"

    def save(self, path: str) -> None:
        documents.write_chunks(path, self.chunks(), {"batchSize": self.batch, "chunkSize": self.size_, "overlap": self.overlap})


class Threads:
    """Descriptions of threads with their embeddings, found by likeness."""

    def __init__(self, spark: SparkSession, embed: Callable = providers.hashed):
        self.spark, self.embed, self.rows = spark, embed, []

    def add(self, description: str, begin: int, end: int) -> int:
        self.rows.append((len(self.rows), f"thread-{len(self.rows)}", description, begin, end, self.embed([description])[0].tolist()))
        return len(self.rows) - 1

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "chunk_pos bigint, id string, description string, begin bigint, end bigint, embedding array<double>")

    def lookup(self, text: str, k: int = 3, least: float = 0.0) -> DataFrame:
        return vector_index.query(self.table(), self.embed([text])[0].tolist(), k, least, F.lit(True))

    def remove(self, ordinal: int) -> None:
        self.rows = [r for r in self.rows if r[0] != ordinal]


def lookup_messages(messages: DataFrame, text: str, k: int = 5, least: float = 0.0, subset: DataFrame | None = None, embed: Callable = providers.hashed) -> DataFrame:
    """Messages most like a text, of all or of a subset (message_ordinal), with score."""
    rows = messages if subset is None else messages.join(subset, "message_ordinal", "left_semi")
    chunks = rows.select(F.col("message_ordinal").alias("chunk_pos"), F.array_join("text_chunks", " ").alias("text"))
    found = vector_index.query(providers.embed(chunks, embed), embed([text])[0].tolist(), k, least, F.lit(True))
    return found.select(F.col("chunk_pos").alias("message_ordinal"), "score")
