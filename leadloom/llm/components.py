"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import dropped, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least).distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """``id, component`` (its smallest id) of every id in ``edges`` (``a, b``: ids linked, in any order, self-links ignored).

    A step moves each node's edges to its smallest neighbour; a hub's edges are joined to
    one row, which Spark may split, and never gathered. Every step is a written table, and the step
    before it is deleted then.
    It ends when a step changes nothing, after about log(n) steps.
    """
    at = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = F.struct(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)))
    seen = at.agg(mark).head()[0]
    while seen[0]:
        before, at = at, written(_small(_large(at)), name)
        dropped(before)
        now = at.agg(mark).head()[0]
        if now == seen:
            break
        seen = now
    return at.select(F.col("a").alias("id"), F.col("b").alias("component")).union(at.select("b", "b").distinct())
