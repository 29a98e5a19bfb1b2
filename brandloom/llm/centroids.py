"""Centroid clustering with integer arithmetic in JVM expressions.

Vectors are turned into integers once and stored. In each round the centroids are literal arrays:
zip_with and aggregate give a vector's squared distance to each, array_min over structs (distance,
number) its cluster, and one aggregation the sums of all components by cluster, partial in each
task. What comes back to the driver is k rows of sums; all arithmetic is exact, so the result
hangs neither on the order of rows nor on their partitions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import stored


def integer_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and v (array<long>) of the vectors with `size` components, none null or not finite.

    A component x becomes floor(scale * x) in doubles.
    """
    raw = F.col("embedding").cast("array<double>")
    sound = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(raw, lambda x: F.floor(x * F.lit(float(scale))))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == size) & F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose seed and id have the least sha256, in that order; ties by the vector."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """A struct of the squared distance and the number of the nearest centroid, ties to the smaller."""
    def to(c: list[int]) -> Column:
        literal = F.expr(f"array({','.join(f'{x}L' for x in c)})")
        apart = F.zip_with(v, literal, lambda a, b: (a - b) * (a - b))
        return F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.array_min(F.array(*[F.struct(to(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(vectors: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The centroids after a round: floored means of their vectors; one without vectors stays."""
    near = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.expr(f"sum(v[{i}]) AS s{i}") for i in range(size)])
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of each kept row of vectors (vec_id, embedding), and the final centroids.

    Vectors of another size, with a null or a component that is not finite, and null vectors are
    left out. Rows that repeat a vec_id count each; a null one is hashed as empty. With fewer than
    k vectors there are as many centroids as vectors; without any no rows. Components beyond about
    1e14 in size stop the job by an overflow error. Other columns are not read.
    """
    kept = stored(integer_vectors(vectors, size, scale))
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(kept, centroids, size)
    near = kept.select("vec_id", nearest(F.col("v"), centroids).alias("near"))
    return near.select("vec_id", "near.cluster", "near.distance"), centroids


def clustered(vectors: DataFrame, **settings: int) -> DataFrame:
    """Each kept vector with its cluster, distance, both sums of distances and its centroid's digest."""
    found, centroids = clusters(vectors, **settings)
    found = stored(found)
    inertia = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    of = F.get(F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))]).cast("array<long>"), F.col("cluster"))
    digest = F.get(F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]).cast("array<string>"), F.col("cluster"))
    return found.select("vec_id", "cluster", "distance", of.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
