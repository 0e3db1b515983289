"""The index as written tables: postings in order of their terms, refs and messages in order of their ordinals.

A term filter on the postings skips all row groups but its own, and a range of ordinals those of the others. Additions are
further folders; what is written is never written again.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import ingest, postings


def folder(spark: SparkSession) -> str:
    """The folder that executors share, or the session's own where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        kept = tempfile.TemporaryDirectory(prefix="palaver-")
        atexit.register(kept.cleanup)
        spark.sparkContext.setCheckpointDir(where := kept.name)
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table: it is computed once, and read again if an executor is lost."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Messages, refs and postings of a conversation under one path."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 0):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def add(self, knowledge: DataFrame) -> Store:
        """Append messages with their knowledge. Ordinals of messages are the caller's and run on; refs are numbered after those already there."""
        base = 0
        if self.parts:
            base = self.refs.agg(F.coalesce(F.max("semantic_ref_ordinal") + 1, F.lit(0)).alias("n")).collect()[0]["n"]
        at = f"{self.path}/{self.parts}"
        knowledge.select("conv_id", "message_ordinal", "text_chunks", "ts").repartitionByRange("message_ordinal").sortWithinPartitions("message_ordinal").write.parquet(f"{at}/messages")
        refs = ingest.populate(knowledge, base)
        refs.repartitionByRange("semantic_ref_ordinal").sortWithinPartitions("semantic_ref_ordinal").write.parquet(f"{at}/refs")
        refs = self.spark.read.parquet(f"{at}/refs")
        postings.of(refs).repartitionByRange("term", "semantic_ref_ordinal").sortWithinPartitions("term", "semantic_ref_ordinal").write.parquet(f"{at}/postings")
        return Store(self.spark, self.path, self.parts + 1)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{k}/{name}" for k in range(self.parts)])

    @property
    def messages(self) -> DataFrame:
        return self._table("messages")

    @property
    def refs(self) -> DataFrame:
        return self._table("refs")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")
