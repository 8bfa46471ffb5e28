"""Feedback on served recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.functions.scalars import pct_rate


def feedback_join(served: DataFrame, actions: DataFrame, window_seconds: int = 86_400) -> DataFrame:
    """Each served row with the earliest later action on it in the window.

    ``served`` is (served_id, customer_id, product_id, ts), ``actions`` is
    (action_id, customer_id, product_id, ts, action). An action counts when it
    is later than the serving and not more than ``window_seconds`` later.

    Time is cut into buckets as long as the window; an action is put into its
    own bucket and the one before, so (customer, product, bucket) holds all
    that a served row can see. Inside it one backward running pass finds the
    next action: no pair of rows is formed and a hot customer is split by time.
    A null customer or product equals no other: such a served row stays
    unanswered, such an action answers nothing.
    """
    keyed = F.col("customer_id").isNotNull() & F.col("product_id").isNotNull()
    unkeyed, served, actions = served.filter(~keyed), served.filter(keyed), actions.filter(keyed)
    width = window_seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    bucket = F.floor(micros / F.lit(width))
    none = F.lit(None)
    left = served.select(
        "customer_id", "product_id", F.col("served_id"), micros.alias("us"), bucket.alias("bucket"),
        none.cast("struct<us: bigint, action_id: bigint, action: string>").alias("next"),
    )
    right = actions.select(
        "customer_id", "product_id", none.cast("long").alias("served_id"), micros.alias("us"),
        F.explode(F.array(bucket, bucket - 1)).alias("bucket"),
        F.struct(micros.alias("us"), F.col("action_id").cast("long").alias("action_id"), F.col("action")).alias("next"),
    )
    # Backward in time; at equal times the served row comes first and so does
    # not see the action, and of equal actions the lowest id is seen last.
    order = Window.partitionBy("customer_id", "product_id", "bucket").orderBy(
        F.desc("us"), F.col("served_id").isNull(), F.desc("next.action_id")
    )
    later = F.last("next", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matched = left.unionByName(right).withColumn("later", later).filter(F.col("served_id").isNotNull())
    in_time = F.col("later.us") - F.col("us") <= width
    unanswered = unkeyed.select(
        "served_id", "customer_id", "product_id", none.cast("string").alias("action"), none.cast("double").alias("delay_seconds")
    )
    answered = matched.select(
        "served_id",
        "customer_id",
        "product_id",
        F.when(in_time, F.col("later.action")).alias("action"),
        F.when(in_time, (F.col("later.us") - F.col("us")) / F.lit(1_000_000.0)).alias("delay_seconds"),
    )
    return answered.unionByName(unanswered)


def feedback_metrics(joined: DataFrame, catalog: DataFrame) -> DataFrame:
    """CTR, conversion rate and catalogue coverage of the served rows."""
    n_catalog = catalog.select(F.countDistinct("product_id")).scalar()
    served = F.count(F.lit(1))
    return joined.agg(
        served.alias("n_served"),
        pct_rate(F.count_if(F.col("action").isNotNull()), served).alias("ctr_pct"),
        pct_rate(F.count_if(F.col("action") == "purchase"), served).alias("conversion_pct"),
        F.countDistinct("product_id").alias("n_products"),
    ).withColumn("coverage_pct", pct_rate(F.col("n_products"), n_catalog))
