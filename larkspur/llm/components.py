"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: neighbours are linked to the least node next to their centre.

    The least neighbour is found with partial aggregation and joined back, so a
    centre with very many neighbours is never gathered in one task.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not small:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("c"))
    if small:
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of an edge reaches.

    Alternating large-star and small-star steps until the edges are stars whose
    centres are their components; each step is checkpointed.
    """
    now = scratch.cut(edges.select("u", "v").filter("u <> v").distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = scratch.cut(_star(_star(now, small=False), small=True))
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
