"""The corpus pipeline: from documents to packed training sequences, in five written stages.

Each stage takes all rows its predecessor kept, as Parquet, and returns the columns of ``documents``; the last
returns the pieces of the packed sequences. Null and empty texts have no words and go in the first stage; of repeated rows, and of
rows equal but for their id, the near-copy stage keeps one, ties by the smaller id; a null id comes last and is judged like others. Texts of any
length are read whole, columns of any other name pass through to the last stage, and an empty table gives an empty result. All but the last stage's tables
stay until the driver ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import decontaminate, near_texts, packing, quality_rules, suffix_dedup
from palaver.llm.common import fresh, run_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    (quality,) = fresh(docs, "quality")
    return quality_rules.judge(docs, quality=quality).where(F.col(quality)["kept"]).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of five-word shingles in common): the one with the smallest id."""
    return near_texts.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words, or of 400 bytes, that occur elsewhere too."""
    less = suffix_dedup.drop_repeats(docs, words=True)
    return less.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else less


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", rules), ("near_copies", near_copies), ("repeats", repeats), ("benchmark", benchmark), ("packing", pack)]

#: SQL can't express the stages; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{where}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
