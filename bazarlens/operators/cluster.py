"""Scaling, k-means and hybrid (rule + clusters) customer segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.fixed_values import (
    LOYAL_ACTIVE,
    LOYAL_AT_RISK,
    LOYAL_MIDDLE,
    ORDINARY_SPORADIC,
    SLEEPING_HIGH_VALUE,
)
from bazarlens.functions.quantiles import exact_percentiles
from bazarlens.functions.scalars import hash_order, pct_rate
from bazarlens.operators.celltree import CellTree, euclidean_silhouettes
from bazarlens.operators.profiling import sample_fixed
from bazarlens.session import materialize

SEED = 42
RESTARTS = 10
SILHOUETTE_SAMPLE = 15_000
# Centres that move less have settled.
STANDSTILL = 1e-9
RECURRENT_KS = range(2, 6)
SINGLE_KS = range(2, 7)

Centroids = Sequence[tuple[int, Sequence[float]]]


# --- scaling -----------------------------------------------------------------


def robust_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``{c}_median`` and ``{c}_scale`` (q75 - q25, or 1 where that is 0)."""
    q = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    parameters = []
    for c in columns:
        spread = F.col(f"{c}_p75") - F.col(f"{c}_p25")
        parameters += [F.col(f"{c}_p50").alias(f"{c}_median"), F.when(spread == 0, 1.0).otherwise(spread).alias(f"{c}_scale")]
    return q.select(*parameters)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``{c}_s`` = (c - median) / interquartile range.

    The parameters enter as a scalar subquery, not through a join.
    """
    parameters = robust_parameters(df, columns).select(F.struct("*")).scalar()
    scaled = [
        ((F.col(c) - F.col(f"_p.{c}_median")) / F.col(f"_p.{c}_scale")).alias(f"{c}_s") for c in columns
    ]
    return df.select("*", parameters.alias("_p")).select(*df.columns, *scaled)


def save_model(df: DataFrame, columns: list[str], centroids: Centroids, path: str) -> None:
    """Write the scaling parameters of ``df`` and the centres: one row per centre."""
    parameters = robust_parameters(df, columns).select(F.struct("*")).scalar()
    centres = df.sparkSession.createDataFrame([(int(i), [float(x) for x in c]) for i, c in centroids], "cluster long, centre array<double>")
    centres.select("*", parameters.alias("p")).select("cluster", "centre", "p.*").write.mode("errorifexists").parquet(path)


def assign_saved(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Adds ``cluster`` and ``dist2`` by a saved model; nothing is fitted or rescaled."""
    rows = df.sparkSession.read.parquet(path).orderBy("cluster").collect()
    scaled = df
    for c in columns:
        scaled = scaled.withColumn(f"{c}_s", (F.col(c) - F.lit(rows[0][f"{c}_median"])) / F.lit(rows[0][f"{c}_scale"]))
    return kmeans_assign(scaled, [f"{c}_s" for c in columns], [(r["cluster"], r["centre"]) for r in rows])


# --- k-means -----------------------------------------------------------------


def squared_distance(columns: list[str], center: Sequence[float]) -> Column:
    terms = [(F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, center)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def nearest(columns: list[str], centroids: Centroids) -> Column:
    """struct(dist2, cluster) of the nearest centroid; ties take the lowest id."""
    candidates = [
        F.struct(squared_distance(columns, center).alias("dist2"), F.lit(int(cid)).cast("long").alias("cluster"))
        for cid, center in centroids
    ]
    return F.array_min(F.array(*candidates))


def kmeans_assign(df: DataFrame, columns: list[str], centroids: Centroids) -> DataFrame:
    """Adds ``cluster`` and ``dist2``; the k centroids are literals of the plan."""
    return df.withColumn("nearest", nearest(columns, centroids)).select("*", "nearest.cluster", "nearest.dist2").drop("nearest")


def kmeans_step(df: DataFrame, columns: list[str], centroids: Centroids) -> DataFrame:
    """One Lloyd update: the mean of the points of each centroid."""
    return (
        kmeans_assign(df, columns, centroids)
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
    )


def inertia(df: DataFrame, columns: list[str], centroids: Centroids) -> DataFrame:
    """Sum of squared distances to the own centroid."""
    return kmeans_assign(df, columns, centroids).agg(F.sum("dist2").alias("inertia"), F.count(F.lit(1)).alias("n"))


def starting_centres_all(df: DataFrame, columns: list[str], key: str, k: int, seeds: Sequence[int]) -> list[np.ndarray]:
    """For every seed k rows, each the farthest from those before it; the first has the least hash of its key.

    Looks at all rows, so a small cluster far from the others is not missed.
    The first j of them are the start for j clusters. Equal distances go to
    the least key. All seeds take a step together, in one scan.
    """
    point = F.struct(*columns)
    firsts = df.agg(*[F.min_by(point, F.struct(hash_order(F.col(key), seed), F.col(key))) for seed in seeds]).first()
    starts = [[tuple(float(x) for x in first)] for first in firsts]
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    names = ["at", "gap", "key", *[f"x{d}" for d in range(len(columns))]]
    schema = f"at int, gap double, key {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{x} double" for x in names[3:])

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's farthest row of every seed."""
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = batch.column(0), [batch.column(1 + d).to_numpy() for d in range(len(columns))]
            picked = []
            for centres in starts:
                gap = np.min([sum((v - c) * (v - c) for v, c in zip(x, centre)) for centre in centres], axis=0)
                ties = np.flatnonzero(gap == gap.max())
                least = pc.sort_indices(keys.take(pa.array(ties)))[0].as_py() if len(ties) > 1 else 0
                picked.append((ties[least], gap[ties[least]]))
            chosen = batch.take(pa.array([row for row, _ in picked]))
            yield pa.record_batch([pa.array(np.arange(len(starts), dtype=np.int32)), pa.array([gap for _, gap in picked]), *chosen.columns], names=names)

    for _ in range(k - 1):
        found = rows.mapInArrow(farthest, schema).groupBy("at").agg(F.max_by(F.struct(*names[3:]), F.struct("gap", -F.col("key"))).alias("best"))
        for r in found.collect():
            starts[r["at"]].append(tuple(r["best"]))
    return [np.array(centres) for centres in starts]


def starting_centres(df: DataFrame, columns: list[str], key: str, k: int, seed: int = SEED) -> np.ndarray:
    """The starting centres of one seed, see :func:`starting_centres_all`."""
    return starting_centres_all(df, columns, key, k, [seed])[0]


def kmeans_fit_all(
    df: DataFrame, columns: list[str], key: str, ks: Sequence[int], seed: int = SEED, restarts: int = RESTARTS, max_passes: int = 300
) -> dict[int, tuple[Centroids, float]]:
    """Best of several fits for every k: {k: (centroids, cost)}.

    Restart i begins with the centres of seed + i. All restarts of all k
    advance together over the cells of a :class:`CellTree`: cells that one
    centre owns move as sums, and only rows of cells on a border are read, so
    an update is that of plain k-means without a scan per update. A model is
    done when its centres stand still; one that still moves after
    ``max_passes`` is an error. Rows with a null or non-finite coordinate take
    no part. ``key`` is numeric.
    """
    tree = CellTree.build(df.select(key, *columns), columns)
    if len(tree.codes) == 0:
        raise ValueError("no rows to fit")
    starts = starting_centres_all(tree.rows, columns, key, max(ks), range(seed, seed + restarts))
    models = [(k, centres[:k]) for k in ks for centres in starts]
    best: dict[int, tuple[np.ndarray, float]] = {}
    for _ in range(max_passes):
        updated, costs = tree.update([centers for _, centers in models])
        going = []
        for (k, centers), moved, cost in zip(models, updated, costs):
            if np.abs(moved - centers).max() > STANDSTILL:
                going.append((k, moved))
            elif k not in best or cost < best[k][1]:
                best[k] = (centers, float(cost))
        models = going
        if not models:
            break
    else:
        raise RuntimeError(f"k-means still moves after {max_passes} passes")
    return {k: (list(enumerate(sorted(tuple(map(float, c)) for c in centers))), cost) for k, (centers, cost) in best.items()}


def kmeans_fit(df: DataFrame, columns: list[str], key: str, k: int, seed: int = SEED, restarts: int = RESTARTS) -> tuple[Centroids, float]:
    """(centroids, cost) of the best of several fits."""
    return kmeans_fit_all(df, columns, key, [k], seed, restarts)[k]


# --- silhouette --------------------------------------------------------------


def squared_silhouettes(df: DataFrame, columns: list[str], labels: dict[int, tuple[Column, Sequence[int]]]) -> dict[int, tuple[float, int]]:
    """{name: (mean silhouette, rows)} with squared distances over all rows, for several labellings in two scans.

    A cheaper measure than :func:`euclidean_silhouettes`, which chooses k. The mean squared distance of a point x to a
    cluster is |x|^2 - 2 x m + q, where m is the cluster's mean and q its mean
    |y|^2; so counts, sums and sums of squares per cluster replace all pairs.
    ``labels`` gives for each name the label column and its values. A point
    that is alone in its cluster counts 0.
    """
    square = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    sums = []
    for name, (label, ids) in labels.items():
        for i in ids:
            mine = label == i
            sums.append(F.count_if(mine).alias(f"n_{name}_{i}"))
            sums += [F.sum(F.when(mine, v)).alias(f"{part}_{name}_{i}") for part, v in [("q", square), *[(c, F.col(c)) for c in columns]]]
    row = df.agg(*sums).first()
    means = []
    for name, (label, ids) in labels.items():
        used = [i for i in ids if row[f"n_{name}_{i}"]]
        if len(used) < 2:
            raise ValueError("a silhouette needs at least two clusters")
        own, others = F.lit(None).cast("double"), []
        for i in used:
            n = row[f"n_{name}_{i}"]
            gap = square + F.lit(row[f"q_{name}_{i}"] / n)
            for c in columns:
                gap = gap - F.col(c) * F.lit(2 * row[f"{c}_{name}_{i}"] / n)
            own = F.when(label == i, gap * F.lit(n / (n - 1)) if n > 1 else F.lit(None).cast("double")).otherwise(own)
            others.append(F.when(label != i, gap))
        other = F.least(*others)
        score = F.when(own.isNull() | (F.greatest(own, other) <= 0), 0.0).otherwise((other - own) / F.greatest(own, other))
        means += [F.avg(F.when(label.isNotNull(), score)).alias(f"s_{name}"), F.count(label).alias(f"n_{name}")]
    found = df.agg(*means).first()
    return {name: (found[f"s_{name}"], found[f"n_{name}"]) for name in labels}


def silhouette(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(silhouette, n) of a labelled frame with few clusters, with Euclidean distances between all rows."""
    ids = sorted(r[0] for r in df.select(cluster).distinct().collect() if r[0] is not None)
    return df.sparkSession.createDataFrame([euclidean_silhouettes(df, columns, {0: (F.col(cluster), ids)})[0]], "silhouette double, n long")


def sampled_silhouette(
    df: DataFrame, columns: list[str], key: str, cluster: str = "cluster", sample_size: int = SILHOUETTE_SAMPLE, seed: int = SEED
) -> DataFrame:
    """(silhouette, n) with plain Euclidean distances over a sample.

    ``sample_size`` is the number of rows that the measure is taken from; it
    needs the distances between all of them. Each task gets a block of the
    sample and, as the sample is bounded, all of it, and emits a row a point.
    """
    sample = materialize(sample_fixed(df.select(key, cluster, *columns), key, sample_size, seed), "silhouette-sample")
    blocks = max(1, -(-sample_size // 500))
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")
    everyone = sample.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def score(own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        labels, codes = np.unique(rest[cluster].to_numpy(), return_inverse=True)
        if not len(own) or len(labels) < 2:
            return pd.DataFrame({"s": np.zeros(len(own))})
        sizes = np.bincount(codes).astype(float)
        points = rest[columns].to_numpy(dtype=float)
        gap = own[columns].to_numpy(dtype=float)[:, None, :] - points[None, :, :]
        sums = np.sqrt((gap * gap).sum(axis=2)) @ np.eye(len(labels))[codes]
        mine, rows = np.searchsorted(labels, own[cluster].to_numpy()), np.arange(len(own))
        with np.errstate(divide="ignore", invalid="ignore"):
            a = sums[rows, mine] / (sizes[mine] - 1)
            others = sums / sizes
            others[rows, mine] = np.inf
            b = others.min(axis=1)
            s = (b - a) / np.maximum(a, b)
        s[sizes[mine] == 1] = 0.0
        return pd.DataFrame({"s": np.nan_to_num(s)})

    scored = sample.select("*", block).groupBy("block").cogroup(everyone.groupBy("block")).applyInPandas(score, "s double")
    return scored.agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def k_search(df: DataFrame, columns: list[str], key: str, ks: Sequence[int], restarts: int = RESTARTS) -> list[tuple[int, float, Centroids]]:
    """(k, silhouette, centroids) for every k, the Euclidean silhouettes of all k over all rows.

    Only centroids and one score a k come back to the driver. The model of
    the chosen k is returned, so it is not fitted again.
    """
    fits = kmeans_fit_all(df, columns, key, list(ks), restarts=restarts)
    scores = euclidean_silhouettes(df, columns, {k: (nearest(columns, c)["cluster"], range(k)) for k, (c, _) in fits.items()})
    return [(k, scores[k][0], fits[k][0]) for k in sorted(fits)]


def argmax_k(scores: DataFrame) -> DataFrame:
    """The k with the best silhouette, ties take the smallest k."""
    return scores.orderBy(F.desc("silhouette"), F.asc("k")).limit(1)


# --- statistics and labels ---------------------------------------------------


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """Mean recency, frequency and spend, and size, per cluster."""
    return assigned.groupBy("cluster").agg(
        F.avg("recency").alias("recency"),
        F.avg("frequency").alias("frequency"),
        F.avg("monetary").alias("monetary"),
        F.count(F.lit(1)).alias("n"),
    )


def arg_extreme(stats: DataFrame, value: str) -> DataFrame:
    """Cluster with the least and the largest mean; ties take the lowest id."""
    return stats.agg(
        F.min_by("cluster", F.struct(F.col(value), F.col("cluster"))).alias("cluster_min"),
        F.max_by("cluster", F.struct(F.col(value), -F.col("cluster"))).alias("cluster_max"),
    )


def recurrent_labels(stats: DataFrame) -> DataFrame:
    """(cluster, segmento) of recurrent customers, by ascending mean recency.

    Two clusters are active / at risk; with more, the first three get a name
    and the others none. The windows run over k rows.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.asc("recency"), F.asc("cluster")))
    last = F.row_number().over(Window.orderBy(F.desc("recency"), F.asc("cluster")))
    ranked = stats.select("cluster", rank.alias("pos"), last.alias("from_end"), n.alias("k"))
    of_two = F.when(F.col("from_end") == 1, LOYAL_AT_RISK).when(F.col("pos") == 1, LOYAL_ACTIVE)
    of_more = F.when(F.col("pos") == 1, LOYAL_ACTIVE).when(F.col("pos") == 2, LOYAL_MIDDLE).when(F.col("pos") == 3, LOYAL_AT_RISK)
    return ranked.select("cluster", F.when(F.col("k") == 2, of_two).otherwise(of_more).alias("segmento"))


def single_labels(stats: DataFrame) -> DataFrame:
    """(cluster, segmento) of one-time customers: highest and lowest mean spend.

    Clusters in between stay without a name.
    """
    low = F.row_number().over(Window.orderBy(F.asc("monetary"), F.asc("cluster")))
    high = F.row_number().over(Window.orderBy(F.desc("monetary"), F.asc("cluster")))
    ranked = stats.select("cluster", low.alias("low"), high.alias("high"))
    return ranked.select(
        "cluster", F.when(F.col("low") == 1, ORDINARY_SPORADIC).when(F.col("high") == 1, SLEEPING_HIGH_VALUE).alias("segmento")
    )


def map_labels(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the segment name; ``labels`` has k rows, so it is broadcast."""
    return assigned.join(F.broadcast(labels), "cluster", "left")


SEGMENTED_COLUMNS = ["customer_unique_id", "recency", "frequency", "monetary", "segmento"]


def union_segments(recurrent: DataFrame, single: DataFrame) -> DataFrame:
    return recurrent.select(SEGMENTED_COLUMNS).unionByName(single.select(SEGMENTED_COLUMNS))


def label_group(scaled: DataFrame, centroids: Centroids, recurrent: bool, columns: list[str] | None = None) -> DataFrame:
    """Assign a scaled group to fixed centroids and name its clusters."""
    assigned = kmeans_assign(scaled, columns or ["recency_s", "monetary_s"], centroids)
    stats = cluster_stats(assigned)
    return map_labels(assigned, recurrent_labels(stats) if recurrent else single_labels(stats))


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Size, means and share per segment.

    Customers without a name are left out of the rows but stay in the
    denominator; their number is shown in ``sin_segmento``.
    """
    rows = segmented.groupBy("segmento").agg(
        F.count("customer_unique_id").alias("clientes"),
        F.avg("recency").alias("recency_med"),
        F.avg("frequency").alias("freq_media"),
        F.avg("monetary").alias("monetary_med"),
    )
    everyone = Window.partitionBy()
    unnamed = F.coalesce(F.sum(F.when(F.col("segmento").isNull(), F.col("clientes"))).over(everyone), F.lit(0))
    return (
        rows.withColumn("pct", pct_rate(F.col("clientes"), F.sum("clientes").over(everyone)))
        .withColumn("sin_segmento", unnamed)
        .filter(F.col("segmento").isNotNull())
        .orderBy(F.desc("clientes"), F.asc("segmento"))
    )


def segment_customers(rfm_table: DataFrame, restarts: int = RESTARTS) -> DataFrame:
    """Rule split by frequency, k-means in each part, names by relative order.

    ``rfm_table`` and the scaled groups are written once and read by all fits.
    """
    base = materialize(rfm_table, "rfm")
    parts = []
    for recurrent, ks in [(True, RECURRENT_KS), (False, SINGLE_KS)]:
        group = base.filter(F.col("frequency") >= 2 if recurrent else F.col("frequency") == 1)
        scaled = materialize(robust_scale(group, ["recency", "monetary"]), "scaled")
        found = k_search(scaled, ["recency_s", "monetary_s"], "customer_unique_id", ks, restarts)
        _, _, centroids = max(found, key=lambda r: (r[1], -r[0]))
        parts.append(label_group(scaled, centroids, recurrent))
    return union_segments(*parts)
