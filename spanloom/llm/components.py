"""Connected components of a graph of edges, by large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.frames import stored


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of an edge.

    ``edges`` has columns ``a``, ``b`` (long). Every round hangs the
    neighbours of each node under the smallest one, larger neighbours first,
    then smaller ones; rounds grow with the logarithm of the nodes, not with
    the length of paths. A node with very many neighbours is only ever
    aggregated (minimum) and joined, so no task holds its neighbourhood.
    Loops and repeated edges are ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = _signature(now)
    for _ in range(limit):
        if before[0] == 0:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(small.select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct(), "edges")
        after = _signature(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
