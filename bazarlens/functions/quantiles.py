"""Exact interpolated percentiles by radix selection.

``percentile`` keeps every distinct value of its input in one buffer. Here
doubles become 64-bit keys of the same order, and each of four passes counts
16 bits more of them: a histogram of the first 16 bits tells in which bin a
wanted rank lies, one of the next 16 bits inside that bin, and so on. All
columns and ranks go through together, whatever the values look like.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 16
BINS = 1 << DIGIT
TOP = np.uint64(1 << 63)


def _name(column: str, prob: float) -> str:
    return f"{column}_p{prob * 100:g}".replace(".", "_")


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the doubles; NaN is the largest, as in Spark, and 0.0 equals -0.0."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = np.ascontiguousarray(values).view(np.uint64)
    return np.where(bits & TOP, ~bits, bits | TOP)


def key_value(key: int) -> float:
    bits = np.uint64(key)
    return float(np.array([bits ^ TOP if bits & TOP else ~bits], np.uint64).view(np.float64)[0])


def _histogram(values: DataFrame, prefixes: list[list[int]], depth: int) -> dict[int, list[np.ndarray]]:
    """Per column and open prefix of ``16 * depth`` bits the counts of the next 16 bits.

    A task sends its non-empty bins, which are added up before they reach the
    driver: 65,536 numbers a prefix at most, whatever the number of rows.
    """
    shift = np.uint64(64 - DIGIT * (depth + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(p) * BINS, np.int64) for p in prefixes]
        known = [np.array(p, np.uint64) for p in prefixes]
        for batch in batches:
            weights = batch.column(batch.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False)
            for i, total in enumerate(totals):
                column = batch.column(i)
                present = column.is_valid().to_numpy(zero_copy_only=False) & (weights > 0)
                if not len(known[i]) or not present.any():
                    continue
                key = ordered_keys(column.fill_null(0.0).to_numpy(zero_copy_only=False)[present])
                digits = key >> shift
                at = np.minimum(np.searchsorted(known[i], digits >> np.uint64(DIGIT)), len(known[i]) - 1)
                inside = known[i][at] == digits >> np.uint64(DIGIT)
                cell = at[inside] * BINS + (digits[inside] & np.uint64(BINS - 1)).astype(np.int64)
                np.add.at(total, cell, weights[present][inside])
        for i, total in enumerate(totals):
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.full(len(used), i)), pa.array(used), pa.array(total[used])], names=["at", "cell", "n"])

    bins = values.mapInArrow(count, "at long, cell long, n long").groupBy("at", "cell").agg(F.sum("n").alias("n")).toPandas()
    found = {}
    for i, p in enumerate(prefixes):
        mine = bins[bins["at"] == i]
        total = np.zeros(len(p) * BINS, np.int64)
        total[mine["cell"].to_numpy(np.int64)] = mine["n"].to_numpy(np.int64)
        found[i] = list(total.reshape(len(p), BINS))
    return found


def exact_percentiles(df: DataFrame, columns: list[str], probs: list[float], weight: str | None = None) -> DataFrame:
    """One row: ``{column}_p{100*prob}`` for every column and probability, interpolated between ranks.

    Four passes over ``df``; hand over a written table when it is costly.
    ``weight`` is a whole number that tells how often a row counts. Nulls are
    left out, as are rows with a null or non-positive weight; NaN counts as the
    largest value; without values the percentiles are null.
    """
    count = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)], count.alias("w"))
    sizes: list[int] = []
    #: Per column, the ranks looked for: {rank: (prefix, rank inside it)}.
    open_: list[dict[int, tuple[int, int]]] = []
    for depth in range(64 // DIGIT):
        prefixes = [sorted({p for p, _ in ranks.values()}) for ranks in open_] if open_ else [[0] for _ in columns]
        bins = _histogram(values, prefixes, depth)
        if not open_:
            sizes = [int(bins[i][0].sum()) for i in range(len(columns))]
            for n in sizes:
                places = [(n - 1) * p for p in probs] if n else []
                open_.append({r: (0, r) for place in places for r in (math.floor(place), math.ceil(place))})
        for i, ranks in enumerate(open_):
            below = [np.cumsum(b) for b in bins[i]]
            for rank, (prefix, inside) in ranks.items():
                counts = below[prefixes[i].index(prefix)]
                digit = int(np.searchsorted(counts, inside, side="right"))
                ranks[rank] = (prefix << DIGIT | digit, inside - int(counts[digit - 1] if digit else 0))
    found = []
    for n, ranks in zip(sizes, open_, strict=True):
        for p in probs:
            if not n:
                found.append(None)
                continue
            place = (n - 1) * p
            low, high = (key_value(ranks[r][0]) for r in (math.floor(place), math.ceil(place)))
            found.append(low if low == high else low + (high - low) * (place - math.floor(place)))
    schema = ", ".join(f"{_name(c, p)} double" for c in columns for p in probs)
    return df.sparkSession.createDataFrame([tuple(found)], schema)
