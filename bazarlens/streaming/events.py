"""Streams of behaviour events: counts, scores, sessions, duplicates, feedback.

Each function maps a streaming frame to a streaming frame; ``run_append`` and
``run_update`` start it on what is available now and write a table. Every state
has a watermark, or is one row per (customer, product) where a running total is
asked for. What event time has to close, a visit or a serving without an
answer, leaves the state when time has passed; where no events come any more,
a heartbeat (:func:`with_heartbeats`) moves time on.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlens import schemas
from bazarlens.operators.recommend import DEFAULT_WEIGHTS
from bazarlens.session import fresh_path

DELAY = "1 hour"
HEARTBEAT = "heartbeat"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Event files as they arrive; ``ts`` becomes an instant for watermarks."""
    reader = spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("customer_id"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("product_id"),
    )


def with_heartbeats(events: DataFrame, folder: str) -> DataFrame:
    """The events and, as rows of the type ``HEARTBEAT`` that belong to nobody, the times that were beaten into ``folder``."""
    beats = events.sparkSession.readStream.schema("ts timestamp").parquet(folder)
    return events.unionByName(beats.select("ts", F.lit(HEARTBEAT).alias("event_type")), allowMissingColumns=True)


def beat(spark: SparkSession, folder: str, times: DataFrame | None = None) -> None:
    """Beat the time of ``times`` (one row, ts); without it only the folder is made."""
    beats = spark.createDataFrame([], "ts timestamp") if times is None else times.select(F.col("ts").cast("timestamp"))
    beats.write.mode("append").parquet(folder)


def event_counts(events: DataFrame, width: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Events per customer, type and tumbling window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "customer_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "customer_id", "event_type", "n")
    )


def implicit_scores(events: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Running weighted interactions per customer and product."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return (
        events.filter(F.col("event_type").isin(*weights))
        .groupBy("customer_id", "product_id")
        .agg(F.sum(F.element_at(table, F.col("event_type"))).alias("score"), F.count(F.lit(1)).alias("n_events"))
    )


def sessions(events: DataFrame, gap: str = "12 hours", delay: str = DELAY) -> DataFrame:
    """Visits: runs of events of a customer with pauses shorter than ``gap``, each given once, when it is over.

    Heartbeats end visits and are none.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("customer_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count_if(F.col("event_type") != HEARTBEAT).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .filter(F.col("n_events") > 0)
        .select(
            "customer_id",
            F.col("first_ts").cast("timestamp_ntz").alias("session_start"),
            F.col("last_ts").cast("timestamp_ntz").alias("session_last"),
            "n_events",
            ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1_000_000.0)).alias("dwell_seconds"),
        )
    )


def deduplicate(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event once, however often the tracker delivers it within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


ANSWER_SCHEMA = "served_id long, customer_id long, product_id long, action string, action_us long"


def _settle(served: list[tuple], actions: list[tuple], now: int, width: int) -> tuple[list[tuple], list[tuple], list[tuple], int | None]:
    """(answers that are final, servings and actions that stay, when to look again), all times in microseconds.

    ``served`` are (time, id), ``actions`` are (time, id, action), in order.
    Nothing at or before ``now`` can arrive any more. A serving is settled by
    its first action once no earlier one can come, or by the end of its window.
    """
    final, staying, wakes = [], [], []
    times = [a[0] for a in actions]
    for us, served_id in served:
        at = bisect_right(times, us)
        first = actions[at] if at < len(times) and times[at] <= us + width else None
        due = first[0] if first else us + width
        if due <= now:
            final.append((served_id, first))
        else:
            staying.append((us, served_id))
            wakes.append(due)
    starts = [us for us, _ in staying]
    before = [bisect_left(starts, us) for us in times]
    kept = [a for a, at in zip(actions, before) if a[0] > now or at and a[0] <= starts[at - 1] + width]
    wakes += [a[0] for a in kept if a[0] > now]
    return final, staying, kept, min(wakes, default=None)


def first_actions(served: DataFrame, actions: DataFrame, within: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Every served row once, with the first later action on it inside the window, or none.

    ``served`` and ``actions`` are event streams. Time is cut into stretches
    as long as the window. State per (customer, product, stretch): the
    servings in the stretch and the actions in it and in the next one, which
    are all that may answer them; it is settled when the watermark has passed
    both. Spark's own aggregate holds the state, so no Python is called for a
    key that has no serving. Of actions at one time the lowest id counts. A
    null customer or product equals no other: such a serving has no answer,
    such an action answers nothing; the same holds for a null time. Late
    events are left out, as far as what they belong to is settled.
    """
    width = int(pd.Timedelta(within).value // 1000)
    row = lambda frame, is_action: frame.select(
        "customer_id", "product_id", "ts", F.unix_micros("ts").alias("us"), "event_id",
        F.when(F.lit(is_action), F.col("event_type")).alias("action"), F.col("event_type").eqNullSafe(HEARTBEAT).alias("beat"),
    )
    both = row(served, False).unionByName(row(actions.filter(F.col("event_type") != HEARTBEAT), True)).withWatermark("ts", delay)
    # Each row falls into the stretch pair it begins and the one it ends; a serving belongs to the first only.
    paired = both.select("*", F.window("ts", f"{2 * width} microseconds", f"{width} microseconds").alias("w"))
    is_action = F.col("action").isNotNull()
    placed = paired.filter(is_action | (F.col("us") - F.unix_micros("w.start") < width))
    # What has no customer or product meets nothing, so it need not be brought together.
    alone = F.when(F.col("customer_id").isNull() | F.col("product_id").isNull(), F.col("event_id")).alias("alone")
    open_rows = placed.groupBy("customer_id", "product_id", alone, "w").agg(
        F.collect_list(F.when(~is_action & ~F.col("beat"), F.struct("us", "event_id"))).alias("served"),
        F.collect_list(F.when(is_action, F.struct("us", "event_id", "action"))).alias("acted"),
    )
    closed = open_rows.filter(F.size("served") > 0).select("customer_id", "product_id", F.sort_array("served").alias("served"), F.sort_array("acted").alias("acted"))
    lists = closed.select("customer_id", "product_id", "served.us", "served.event_id", F.col("acted.us").alias("action_us"), F.col("acted.event_id").alias("action_id"), "acted.action")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for customer, product, us, ids, *acted in zip(*(column.to_pylist() for column in batch.columns)):
                seen = [] if customer is None or product is None else list(zip(*acted))
                final, *_ = _settle(list(zip(us, ids)), seen, us[-1] + width, width)
                found += [(i, customer, product, a and a[2], a and a[0]) for i, a in final]
            columns = zip(*found) if found else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, answer_types)], names=["served_id", "customer_id", "product_id", "action", "action_us"])

    answer_types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    answers = lists.mapInArrow(settle, ANSWER_SCHEMA)
    timeless = served.filter(F.col("ts").isNull() & ~F.col("event_type").eqNullSafe(HEARTBEAT)).select(
        F.col("event_id").alias("served_id"), "customer_id", "product_id", F.lit(None).cast("string").alias("action"), F.lit(None).cast("timestamp").alias("action_ts")
    )
    return answers.select("served_id", "customer_id", "product_id", "action", F.timestamp_micros("action_us").alias("action_ts")).unionByName(timeless)


def run_append(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Process what is there, append to an exactly-once parquet table, stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def run_update(stream: DataFrame, keys: list[str], target: str, checkpoint: str, compact_every: int = 20) -> DataFrame:
    """Process what is there and keep the newest row of each key.

    Every micro-batch overwrites its own folder of changes, so a repeated
    batch changes nothing. Every ``compact_every`` batches the newest rows are
    written as a base; a reader takes the last base and the changes since.
    """
    spark = stream.sparkSession
    values = [c for c in stream.columns if c not in keys]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def newest() -> DataFrame:
        rows = spark.read.schema(f"{columns}, kind string, batch_id long").parquet(target)
        base = rows.filter(F.col("kind") == "base").agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
        since = rows.filter((F.col("batch_id") > base) | ((F.col("batch_id") == base) & (F.col("kind") == "base")))
        latest = since.filter((F.col("kind") == "changes") | (F.col("batch_id") == base)).groupBy(*keys)
        return latest.agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/kind=changes/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            newest().write.mode("overwrite").parquet(f"{target}/kind=base/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return newest()


def scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """Target and checkpoint paths of a one-off run in the shared folder."""
    base = fresh_path(spark, label)
    return f"{base}/table", f"{base}/checkpoint"
