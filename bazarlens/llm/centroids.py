"""Centroid clustering in column expressions: integer distances, literal centroids, exact means.

A vector becomes an array of integers. ``zip_with`` and ``aggregate`` give its
squared distance to each centroid, an array literal of the plan; the least of
an array of (distance, number) structs is its cluster. New centroids are
column sums per cluster, of which only k rows come back to the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlens.session import materialize

# Scaled components beyond this would let a squared distance leave 64 bits.
LARGEST = 2**27
LARGEST_LONG = 2**63 - 1


@dataclass(frozen=True)
class Centroids:
    """Parameters; the start is a hash of ``seed`` and the id, so it does not hang on the order of rows."""

    components: int = 64
    clusters: int = 8
    rounds: int = 10
    scale: int = 1024
    seed: str = "3"


def scaled_vectors(vectors: DataFrame, settings: Centroids) -> DataFrame:
    """(vec_id, v): usable vectors as arrays of floor(scale * x)."""
    values = F.col("embedding").cast("array<double>")
    whole = (F.size(values) == settings.components) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(values, lambda x: F.floor(F.greatest(F.least(x * settings.scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("long"))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def starting_centroids(points: DataFrame, settings: Centroids) -> list[list[int]]:
    """The vectors with the least sha256 of ``seed:vec_id``, in that order; a row without id comes last."""
    order = F.sha2(F.concat(F.lit(settings.seed + ":"), F.col("vec_id").cast("string")), 256)
    rows = points.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(settings.clusters).collect()
    return [list(r["v"]) for r in rows]


def distance(vector: Column, centroid: list[int]) -> Column:
    literal = F.array(*[F.lit(x).cast("long") for x in centroid])
    squares = F.zip_with(vector, literal, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid, ties to the smaller number."""
    return F.array_min(F.array(*[F.struct(distance(vector, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Exact floor of the mean of each cluster's vectors; an empty cluster stays."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    assigned = points.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    result = list(centroids)
    for row in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        result[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(len(centroids[0]))]
    return result


def cluster_vectors(vectors: DataFrame, settings: Centroids = Centroids()) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector that is null, has another number of components, or a null or
    non-finite one takes no part and has no row. Components are limited to
    2^27 in size after scaling; a sum of distances beyond 64 bits is given as
    the largest long. Rows that repeat an id are vectors of their own; a row
    without id takes part but starts a centroid only when ids run out. Fewer
    vectors than clusters make fewer centroids. An empty table gives an empty
    result. Only vec_id and embedding are looked at.

    Each round is one scan of the written integer vectors and one small
    aggregate with partial sums per task; rounds end early when no centroid moves.
    """
    points = materialize(scaled_vectors(vectors, settings), "scaled-vectors")
    centroids = starting_centroids(points, settings)
    for _ in range(settings.rounds if centroids else 0):
        before, centroids = centroids, moved(points, centroids)
        if centroids == before:
            break
    if not centroids:
        nothing = points.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.select("*", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    own = points.select("vec_id", nearest(F.col("v"), centroids).alias("own"))
    own = materialize(own.select("vec_id", "own.cluster", "own.distance"), "assigned-vectors")
    sums = {r["cluster"]: int(r["s"]) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per_cluster = F.array(*[F.lit(min(sums.get(i, 0), LARGEST_LONG)).cast("long") for i in range(len(centroids))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    return own.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(per_cluster, "cluster").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LARGEST_LONG)).cast("long").alias("inertia"),
        F.get(digests, "cluster").alias("centroid_sha256"),
    )
