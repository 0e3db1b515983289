"""Nearest neighbours over chunks: exact, in batches, and approximate by cells."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import vectors as V

TOP_K = 5
#: Queries that go to the chunks at once.
BLOCK = 10_000


def nearest(chunks: DataFrame, query, k: int = TOP_K, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest chunks with ``distance``, exact. A filter applies before any arithmetic."""
    q = V.literal(query)
    e = F.col("embedding")
    distance = {"cosine": 1 - V.cosine(e, q), "l2": V.squared_distance(e, q), "ip": -V.dot(e, q)}[metric]
    rows = chunks if where is None else chunks.where(where)
    return rows.withColumn("distance", distance).orderBy("distance", "chunk_pos").limit(k)


def query(chunks: DataFrame, vector, k: int = TOP_K, least: float = 0.0, where: Column | None = None, cosine_mode: bool = False) -> DataFrame:
    """The k best chunks with ``score``: raw cosine where a filter is given, else 1 / (1 + distance) of twice as many neighbours."""
    if where is not None:
        rows = chunks.where(where).withColumn("score", V.cosine(F.col("embedding"), V.literal(vector)))
        return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "chunk_pos").limit(k)
    near = nearest(chunks, vector, 2 * k).withColumn("score", V.score(F.col("distance"), cosine_mode=cosine_mode)).drop("distance")
    return near.where(F.col("score") >= least).orderBy(F.desc("score"), "chunk_pos").limit(k)


def query_many(chunks: DataFrame, queries: list, k: int = TOP_K, least: float = 0.0, where: Column | None = None) -> DataFrame:
    """By the mean of several query vectors."""
    return query(chunks, np.mean(np.array(queries, dtype=float), axis=0).tolist(), k, least, where)


def join_nearest(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, index: CellIndex | None = None) -> DataFrame:
    """(query_id, chunk_pos, distance, rank) for a stated set of queries (query_id, embedding), exact.

    The queries go to the chunks in one block of a size that is checked; each batch of chunks is one matrix product and keeps its k best for each
    query, so what is shuffled is k rows a query and task. With ``index``, chunks have ``cell`` and only a query's probed cells count.
    """
    n = queries.count()
    if n > BLOCK:  # as many blocks as are needed, one after the other
        blocks = 2 * -(-n // BLOCK)
        parts = [join_nearest(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), chunks, k, index) for b in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    block = queries.select("query_id", "embedding").toPandas()  # BLOCK rows at most
    ids = block["query_id"].to_numpy()
    q = np.array(block["embedding"].tolist(), dtype=float)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(q) else q

    probed = None
    if index is not None and len(q):
        order = np.argsort(-(q @ index.centres.T), axis=1)
        probed = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(probed, order[:, : index.probes], True, axis=1)
        chunks = chunks.where(F.col("cell").isin(*np.flatnonzero(probed.any(axis=0)).tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = np.array(pdf["embedding"].tolist(), dtype=float)
            if not len(e) or not len(q):
                continue
            d = 1 - q @ (e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)).T
            if probed is not None:
                d[~probed[:, pdf["cell"].to_numpy()]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            found = pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "chunk_pos": pdf["chunk_pos"].to_numpy()[top.ravel()], "distance": np.take_along_axis(d, top, axis=1).ravel()})
            yield found if probed is None else found[np.isfinite(found["distance"])]

    best = chunks.select("chunk_pos", "embedding", *(["cell"] if index is not None else [])).mapInPandas(run, "query_id bigint, chunk_pos bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_pos"))
    return best.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


class CellIndex:
    """Approximate neighbours: vectors in the cells of their nearest centres; a query looks into its nearest ``probes`` cells.

    Centres are fitted on at most ``sample`` vectors; every vector is indexed. With ``recall``, fitting raises ``probes`` until up to 500 of
    the sampled vectors find that share of their ``TOP_K`` neighbours in the sample. Neighbours are farther apart
    there than among all vectors, so more cells are probed than all of them need. Without ``cells`` there are as many as the square root of
    the number of vectors, so that a query reads as many centres as vectors of a cell.
    """

    def __init__(self, cells: int | None = 32, probes: int = 8, sample: int = 20_000, seed: int = 1, recall: float | None = None):
        self.cells, self.probes, self.sample, self.seed, self.recall = cells, probes, sample, seed, recall
        self.centres = np.empty((0, 0))

    def fit(self, chunks: DataFrame) -> CellIndex:
        n = chunks.count()
        if self.cells is None:
            self.cells = max(1, int(n**0.5))
        some = chunks.where(F.pmod(F.xxhash64("chunk_pos"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, self.sample / max(n, 1))))
        x = np.array([r.embedding for r in some.select("embedding").orderBy("embedding").collect()], dtype=float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        rng = np.random.default_rng(self.seed)
        centres = x[rng.choice(len(x), min(self.cells, len(x)), replace=False)]
        for _ in range(10):
            own = np.argmax(x @ centres.T, axis=1)
            centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
        self.centres = centres
        if self.recall is not None:
            self.probes = max(self.probes, self._enough(x))
        return self

    def _enough(self, x: np.ndarray) -> int:
        """The fewest probes that reach ``recall`` within the sample."""
        own = np.argmax(x @ self.centres.T, axis=1)
        asked = x[np.random.default_rng(self.seed).permutation(len(x))[:500]]
        place = np.argsort(np.argsort(-(asked @ self.centres.T), axis=1), axis=1)  # of each cell in a query's order
        near = np.argsort(-(asked @ x.T), axis=1)[:, :TOP_K]
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel()) + 1
        return int(needed[max(0, int(np.ceil(self.recall * len(needed))) - 1)]) if len(needed) else 0

    def assign(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with ``cell``; written partitioned by it, a query reads only its cells."""
        centres = self.centres

        @F.pandas_udf("int")
        def cell(e: pd.Series) -> pd.Series:
            return pd.Series(np.argmax(np.array(e.tolist(), dtype=float) @ centres.T, axis=1).astype("int32"))

        return chunks.withColumn("cell", cell("embedding"))

    def save(self, assigned: DataFrame, path: str) -> None:
        """Centres and settings, and the vectors partitioned by cell."""
        spark = assigned.sparkSession
        assigned.repartition("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        spark.createDataFrame([(json.dumps({"probes": self.probes, "centres": self.centres.tolist()}),)], "value string").coalesce(1).write.text(f"{path}/index")

    @classmethod
    def load(cls, spark, path: str) -> tuple[CellIndex, DataFrame]:
        """A saved index and its vectors; a query reads only the folders of the cells it probes."""
        kept = json.loads(spark.read.text(f"{path}/index").head()[0])
        index = cls(len(kept["centres"]), kept["probes"])
        index.centres = np.array(kept["centres"], dtype=float)
        return index, spark.read.parquet(f"{path}/vectors")

    def search(self, assigned: DataFrame, query, k: int = TOP_K) -> DataFrame:
        near = np.argsort(-(self.centres @ np.array(query, dtype=float)))[: self.probes]
        return nearest(assigned.where(F.col("cell").isin(*[int(c) for c in near])), query, k)

    def search_many(self, assigned: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
        """(query_id, chunk_pos, distance, rank) for a stated set of queries (query_id, embedding); each looks into its own cells."""
        return join_nearest(queries, assigned, k, self)


class ExactIndex:
    """All vectors are looked at; ``metric`` is cosine, l2 or ip."""

    def __init__(self, metric: str = "cosine"):
        self.metric = metric

    def fit(self, chunks: DataFrame) -> ExactIndex:
        return self

    def assign(self, chunks: DataFrame) -> DataFrame:
        return chunks

    def search(self, assigned: DataFrame, query, k: int = TOP_K) -> DataFrame:
        return nearest(assigned, query, k, self.metric)


def create_index(kind: str = "cosine", **settings) -> ExactIndex | CellIndex:
    """An index by its name: an exact one by metric, or "cells" for approximate search."""
    if kind == "cells":
        return CellIndex(**settings)
    if kind not in ("cosine", "l2", "ip"):
        raise ValueError(f"no such index: {kind}")
    return ExactIndex(kind)


def remove(chunks: DataFrame, ids: list[str]) -> tuple[DataFrame, int]:
    """Chunks without those of these ids, and how many went; by id, so nothing shifts."""
    gone = chunks.where(F.col("id").isin(*ids)) if ids else chunks.limit(0)
    return chunks.where(~F.col("id").isin(*ids)) if ids else chunks, gone.count()
