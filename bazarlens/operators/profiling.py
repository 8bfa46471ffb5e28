"""Table profiles: sizes, nulls, value counts, numeric summaries, samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlens.functions.quantiles import exact_percentiles
from bazarlens.functions.scalars import hash_order


def profile_table(df: DataFrame, table_name: str) -> DataFrame:
    """One row per column: type, row count, null count; a single pass."""
    nulls = [F.count_if(F.col(f.name).isNull()).alias(f.name) for f in df.schema]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *nulls)
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.col(f.name).alias("n_null"),
        )
        for f in df.schema
    ]
    return wide.select(
        F.lit(table_name).alias("table_name"), "n_rows", F.lit(len(entries)).cast("long").alias("n_columns"), F.inline(F.array(*entries))
    )


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per value, nulls left out, most frequent first."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(key))
    )


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    moments = df.agg(
        *[
            f(F.col(c).cast("double")).alias(f"{c}_{name}")
            for c in columns
            for name, f in [("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]
        ]
    )
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    moments = moments.select("*", quartiles.select(F.struct("*")).scalar().alias("q"))
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}_count").alias("n"),
            F.col(f"{c}_mean").alias("mean"),
            F.col(f"{c}_std").alias("std"),
            F.col(f"{c}_min").alias("min"),
            F.col(f"q.{c}_p25").alias("p25"),
            F.col(f"q.{c}_p50").alias("p50"),
            F.col(f"q.{c}_p75").alias("p75"),
            F.col(f"{c}_max").alias("max"),
        )
        for c in columns
    ]
    return moments.select(F.inline(F.array(*rows)))


def sample_fixed(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` pseudo-random rows, the same for every run and partitioning.

    The n least hashes. A bound on the hash, from the number of rows, lets
    about 2n rows pass; a wider one is taken should fewer than n pass. So the
    final top n sees a number of rows fixed by n, however many tasks there are.
    """
    place = hash_order(F.col(key), seed)
    share = 2 * n / max(df.count(), 1)
    while True:
        # The hash is hexadecimal text; its first 13 digits as a share of their range.
        bound = f"{min(int(share * 16**13), 16**13 - 1):013x}"
        passing = df if share >= 1 else df.filter(place < bound)
        if share >= 1 or passing.limit(n).count() >= n:
            return passing.orderBy(place, F.col(key)).limit(n)
        share *= 4


def top_k(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows; each task keeps only k of them."""
    return df.orderBy(*by).limit(k)


# --- user functions over columns ------------------------------------------------


def apply_columns(df: DataFrame, columns: list[str], function: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    """``df`` with ``function`` applied to each of the columns, in place or, with a suffix, beside them.

    The function builds an expression, so nothing leaves the JVM; all columns
    are made in one projection.
    """
    return df.withColumns({c + suffix: function(F.col(c)) for c in columns})


def aggregate_by(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """One row per key with ``{name: (column, function)}``, each function an aggregate expression of its column.

    What a function is made of is combined on the map side like any built-in
    aggregate.
    """
    return df.groupBy(*keys).agg(*[function(F.col(column)).alias(name) for name, (column, function) in aggregates.items()])
