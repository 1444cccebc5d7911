"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import stored


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the smallest node it reaches.

    Every round hooks each node's neighbours to the smallest of them, with minima that are
    combined before the shuffle; no neighbourhood is gathered. Rounds are written, so that the
    plan stays short and survives lost executors. The number of rounds grows with the logarithm
    of the table; stars end after two.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stored(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = stored(
            both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large-star",
        )
        down = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(down, "a").select(
            F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
        )
        now = stored(
            small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "edges"
        )
        after = _digest(now)
        if after == seen:
            break
        seen = after
    tips = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return tips.union(now.select("b", F.col("b").alias("c")).distinct())
