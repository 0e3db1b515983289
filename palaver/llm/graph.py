"""Connected components by randomised contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a and b, long); nodes of one component have one root.

    In each round every node goes over to the one of itself and its neighbours that comes first in
    a fresh random order, and the edges between the nodes so left are what the next round sees. That
    keeps components whole, shrinks the graph by a constant factor a round, and gathers no
    neighbours anywhere: the minimum is combined before the shuffle. Self loops and nulls are dropped.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c, k=len(maps): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("x"))
        both = edges.select(F.col("a").alias("node"), order("b").alias("o")).unionByName(edges.select(F.col("b").alias("node"), order("a").alias("o")))
        first = both.groupBy("node").agg(F.min("o").alias("o"))
        to = stage(first.select("node", F.least("o", order("node"))["x"].alias("to")))
        maps.append(to)
        side = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = edges.join(side("a"), "a").join(side("b"), "b").where("a_to <> b_to")
        edges = stage(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("to").alias("root"))
    for to in reversed(maps[:-1]):
        nearer = roots.select(F.col("node").alias("to"), "root")
        roots = stage(to.join(nearer, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return roots
