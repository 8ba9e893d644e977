"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) of every end of edges (u, v): the smallest id that links reach. Stored; empty for no edges.

    Alternates large-star and small-star steps until nothing moves, which takes about the logarithm of the longest
    path. A step finds each vertex' least neighbour with a partial aggregate and joins it to the links, so a vertex with
    very many links is a skewed join that adaptive execution splits, and never a group in one task. Loops are ignored.
    """
    kept = Scratch(edges.sparkSession)
    edges = kept.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before = _mark(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(limit):
        last, kept = kept, Scratch(edges.sparkSession)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = last.written(both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.col("k")).alias("m")), "least")
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = last.written(large.filter("u <> v").distinct(), "large")
        least = last.written(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least")
        small = large.join(least, F.col("u") == F.col("k")).select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept.written(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        last.remove()
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    rooted = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    rooted = written(rooted.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    kept.remove()
    return rooted
