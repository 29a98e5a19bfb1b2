"""Connected components of links by alternating large-star and small-star steps.

Each step joins and aggregates narrow pairs of ids; a node's links are reduced to their minimum
before they meet, and lists of neighbours are never built. Ends when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: link larger neighbours to the least; small: the smaller ones."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component for every id of links (a, b); component is the least id that is reachable."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        edges = stored(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
