"""CSV with line ends inside quotes, read by many tasks per file.

A line end is inside a quoted field exactly if the number of quotes before it
is odd. Tasks count quotes in their byte ranges without knowing what came
before; a running sum over the ranges, a row each, tells where each one
starts. Then every line knows whether it begins a record. Most records are one
line; only those of several lines are brought together, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazarlens.session import materialize

OPTIONS = {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}
LINES = "file string, block long, line long, before long, quotes long, start_even long, start_odd long, value string"


def _latest(flags: np.ndarray, numbers: np.ndarray, last: int) -> np.ndarray:
    """The number of the latest flagged line up to each line, ``last`` before the first."""
    return np.maximum.accumulate(np.where(flags, numbers, -1).clip(min=last)) if len(flags) else numbers


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its place: byte range, number in it, quotes before and in it.

    ``start_even`` and ``start_odd`` are the latest line of the range that
    begins a record, should the range start outside or inside quotes.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count, quotes_before, even, odd = None, 0, 0, -1, -1
        for batch in batches:
            # A batch may hold the end of one range and the start of another.
            keys = list(zip(batch.column(0).dictionary_encode().indices.to_pylist(), batch.column(1).to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                part = batch.slice(first, last - first)
                here = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if here != place:
                    place, count, quotes_before, even, odd = here, 0, 0, -1, -1
                quotes = pc.count_substring(part.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64)
                before = quotes_before + np.cumsum(quotes) - quotes
                numbers = count + np.arange(len(quotes))
                starts = _latest(before % 2 == 0, numbers, even), _latest(before % 2 == 1, numbers, odd)
                yield pa.record_batch(
                    [part.column(0), part.column(1), *(pa.array(x) for x in (numbers, before, quotes, *starts)), part.column(2)],
                    names=["file", "block", "line", "before", "quotes", "start_even", "start_odd", "value"],
                )
                count, quotes_before, even, odd = count + len(quotes), int(before[-1] + quotes[-1]), int(starts[0][-1]), int(starts[1][-1])

    return raw.mapInArrow(run, LINES)


def _ranges(lines: DataFrame) -> DataFrame:
    """Per byte range: quotes before it in its file, and the record that is open where it starts."""
    sums = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max("start_even").alias("start_even"), F.max("start_odd").alias("start_odd")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("offset", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    start = F.when(F.col("offset") % 2 == 0, F.col("start_even")).otherwise(F.col("start_odd"))
    begun = F.when(start >= 0, F.struct(F.col("block").alias("block"), start.alias("line")))
    return placed.withColumn("begun", begun).select("file", "block", "offset", "quotes", F.last("begun", ignorenulls=True).over(earlier).alias("open"))


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, block, line, value) of the records of CSV files, at the place of their first line; None if a file's quotes do not pair up."""
    lines = materialize(numbered_lines(spark, path), "csv-lines")
    ranges = materialize(_ranges(lines), "csv-ranges")
    if not ranges.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").isEmpty():
        return None
    # A range has 64 MB or more of lines, so this side is small; adaptive execution measures it.
    known = lines.join(ranges.select("file", "block", "offset", "open"), ["file", "block"])
    begins = (F.col("offset") + F.col("before")) % 2 == 0
    ends = (F.col("offset") + F.col("before") + F.col("quotes")) % 2 == 0
    single = known.where(begins & ends).select("file", "block", "line", "value")
    start = F.when(F.col("offset") % 2 == 0, F.col("start_even")).otherwise(F.col("start_odd"))
    own = F.when(start >= 0, F.struct(F.col("block").alias("block"), start.alias("line"))).otherwise(F.col("open"))
    several = (
        known.where(~(begins & ends))
        .groupBy("file", own.alias("own"))
        .agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
        .select("file", "own.block", "own.line", F.array_join(F.col("parts.value"), "\n").alias("value"))
    )
    return single.unionByName(several)


def read_split_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """All columns as text, as the multi-line reader gives them; None if a file's quotes do not pair up.

    The first record of each file is its header. Empty lines between records
    are left out. In a file whose header ends with a carriage return and line
    feed, that pair is the line end, inside quotes as well.
    """
    columns = spark.read.options(**OPTIONS).option("header", True).csv(path).columns
    found = records(spark, path)
    if found is None:
        return None
    header = (F.col("block") == 0) & (F.col("line") == 0)
    pairs = found.where(header & F.col("value").endswith("\r")).select("file", F.lit(True).alias("pairs"))
    text = F.when(F.col("pairs"), F.regexp_replace(F.regexp_replace("value", "\r$", ""), "\r\n", "\n")).otherwise(F.col("value"))
    rows = found.where(~header).join(pairs, "file", "left").select(text.alias("value")).where("value <> ''")
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    return rows.select(F.from_csv("value", schema, OPTIONS).alias("r")).select("r.*")
