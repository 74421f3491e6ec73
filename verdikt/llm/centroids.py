"""Clusters of embedding vectors in whole numbers, by expressions that stay in the JVM.

The vectors, as arrays of small integers, are written once; each round reads them, works out the distance to every centroid by
``zip_with`` and ``aggregate`` over a literal array of the centroids, takes the least (distance, number) by ``array_min``, and sums
every component per cluster.  Partial sums meet in the map tasks, so a round shuffles one row per task and cluster, and the driver
gets one row per cluster, whatever the number of vectors or their likeness.

Defined results: vectors that are null, have another number of components, or hold a null or non-finite one are left out; components
beyond ±LIMIT after scaling count as ±LIMIT, so that distances fit a long; an inertia beyond a long is null; a null vec_id is hashed as
empty text; repeated ids are vectors of their own, ordered by their components where they are first centroids; fewer vectors than
clusters give fewer clusters; an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from ..session import landed

COMPONENTS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LIMIT = 1 << 26


def whole_numbers(vector: Column, scale: int, limit: int) -> Column:
    """Components times ``scale``, rounded down, within ±``limit``."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(limit))), F.lit(float(-limit)))).cast("int"))


def finite(vector: Column) -> Column:
    """No component is null, NaN or infinite."""
    return F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def nearest(q: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; of equally near ones the smaller number."""
    table = F.expr("array(" + ", ".join(f"array({', '.join(f'{x}L' for x in c)})" for c in centroids) + ")")

    def to(c: Column, number: Column) -> Column:
        squares = F.zip_with(q, c, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("distance"), number.cast("int").alias("cluster"))

    return F.array_min(F.transform(table, to))


def updated(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by its vectors' mean, rounded down; those without vectors stay."""
    sums = [F.sum(F.get("q", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(len(centroids[0]))]
    rows = vectors.select("q", nearest(F.col("q"), centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums)
    out = list(centroids)
    for cluster, n, *totals in rows.collect():  # one row per cluster
        out[cluster] = [t // n for t in totals]
    return out


def clustered(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    vector = F.col("embedding").cast("array<double>")
    vectors = landed(df.filter((F.size(vector) == components) & finite(vector)).select("vec_id", whole_numbers(vector, scale, LIMIT).alias("q")), "centroids-vectors")
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = [list(r[0]) for r in vectors.orderBy(key, "q").limit(clusters).select("q").collect()]
    if not centroids:
        none = F.lit(0).cast("bigint")
        return vectors.filter("false").select("vec_id", F.lit(0).alias("cluster"), none.alias("distance"), none.alias("cluster_inertia"), none.alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = updated(vectors, centroids)
    assigned = landed(vectors.select("vec_id", nearest(F.col("q"), centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"), "centroids-assigned")
    totals = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.try_sum("distance")).collect()}
    known = {c: t for c, t in totals.items() if t is not None}
    whole = sum(known.values()) if len(known) == len(totals) else None
    per_cluster = ", ".join(f"{known[c]}L" if c in known else "CAST(NULL AS BIGINT)" for c in range(len(centroids)))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(F.expr(f"array({per_cluster})"), "cluster").alias("cluster_inertia"),
        F.lit(whole if whole is not None and whole < 1 << 63 else None).cast("bigint").alias("inertia"),
        F.get(F.array(*map(F.lit, hashes)), "cluster").alias("centroid_sha256"),
    )
