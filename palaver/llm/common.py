"""What several of the corpus operators share: the shared folder, word rules, byte batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of text in one Arrow batch; a batch of very long texts is limited by bytes as well.
TEXT_ROWS = 500
TEXT_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set (local mode)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not sc.getCheckpointDir():
        kept = tempfile.TemporaryDirectory(prefix="palaver-")
        atexit.register(kept.cleanup)
        sc.setCheckpointDir(kept.name)
    return sc.getCheckpointDir()


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. Results are lazy and may read its tables, so it stays until the driver
    ends (or ``tidy`` is called)."""
    path = f"{shared_dir(spark).rstrip('/')}/palaver-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        _RUNS.add(path)
        atexit.register(tidy, spark)
    return path


_RUNS: set[str] = set()


def tidy(spark: SparkSession) -> None:
    """Delete all written tables of this application."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, f"{shared_dir(spark).rstrip('/')}/palaver-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, executors may be lost."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._stage_path = path
    return staged


def release(spark: SparkSession, *staged: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop shuffle files that nothing refers to.

    Only for tables all of whose results are themselves written: a lost executor then asks for none of them again.
    """
    for df in staged:
        _delete(spark, df._stage_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark's cleaner follows the driver's garbage collection


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for what is run inside; then the former setting again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    were = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, were)


def text_batches(spark: SparkSession) -> None:
    """Keep batches that go to Python small in bytes, whatever the length of a text.

    The session keeps these settings: an operator's result is lazy, and what holds when it runs decides.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def words(text: Column) -> Column:
    """Words of ``text``, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever extra columns it brings."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
