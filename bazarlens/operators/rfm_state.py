"""RFM kept up to date: per-customer sums as a folded table plus one delta per batch of orders.

A batch is read once, when it comes. Its customers' sums are written as a
delta; what is asked later adds the folded table and the deltas behind it. The
recency of everybody follows from one date, so a moved reference date rewrites
nothing.

    state/references/batch=N   latest order date of the batch
    state/deltas/batch=N       (customer_unique_id, latest, frequency, monetary) of the batch
    state/folded/upto=N        the same of all batches up to N

A part counts when it is complete, so a lost run is repeated and leaves no
trace; batches have ascending numbers from 1 on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlens.functions.scalars import recency_days, reference_date
from bazarlens.operators.rfm import customer_accounts
from bazarlens.operators.sales import filter_delivered
from bazarlens.sources.documents import file_system


def _complete(spark: SparkSession, path: str) -> bool:
    files, done = file_system(spark, f"{path}/_SUCCESS")
    return files.exists(done)


def _numbers(spark: SparkSession, base: str, kind: str, name: str) -> list[int]:
    """Ascending numbers of the complete parts of a kind."""
    files, folder = file_system(spark, f"{base}/{kind}")
    names = [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))
    return [n for n in found if _complete(spark, f"{base}/{kind}/{name}={n}")]


def add_orders(base: str, batch: int, orders: DataFrame, items: DataFrame, customers: DataFrame) -> None:
    """Take in the orders of a batch that were delivered; a batch that is complete already is left as it is.

    An order is given in one batch, the one in which it is delivered, with its
    items; ``items`` and ``customers`` may hold more than the batch needs.
    """
    spark = orders.sparkSession
    delta = f"{base}/deltas/batch={batch}"
    if _complete(spark, delta):
        return
    delivered = filter_delivered(orders)
    # The date looks at all delivered orders, also those without items; it is there before the delta counts.
    delivered.agg(F.max("order_purchase_timestamp").alias("latest")).write.mode("overwrite").parquet(f"{base}/references/batch={batch}")
    sums = (
        customer_accounts(orders, items, customers)
        .filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.max("latest").alias("latest"), F.sum("n_orders").alias("frequency"), F.sum("ingresos").alias("monetary"))
    )
    sums.write.mode("overwrite").parquet(delta)


def _parts(spark: SparkSession, base: str) -> list[str]:
    folded = _numbers(spark, base, "folded", "upto")
    upto = folded[-1] if folded else 0
    paths = [f"{base}/folded/upto={upto}"] if folded else []
    paths += [f"{base}/deltas/batch={n}" for n in _numbers(spark, base, "deltas", "batch") if n > upto]
    if not paths:
        raise FileNotFoundError(f"no orders have been added under {base}")
    return paths


def _summed(parts: list[DataFrame]) -> DataFrame:
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("customer_unique_id")
        .agg(F.max("latest").alias("latest"), F.sum("frequency").alias("frequency"), F.sum("monetary").alias("monetary"))
    )


def customer_sums(spark: SparkSession, base: str) -> DataFrame:
    """(customer_unique_id, latest, frequency, monetary) of all batches."""
    return _summed([spark.read.parquet(path) for path in _parts(spark, base)])


def changed_sums(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """The same for the customers of one batch only; others leave every part before anything is added up."""
    customers = spark.read.parquet(f"{base}/deltas/batch={batch}").select("customer_unique_id")
    return _summed([spark.read.parquet(path).join(customers, "customer_unique_id", "left_semi") for path in _parts(spark, base)])


def latest_reference(spark: SparkSession, base: str) -> Column:
    """The reference date after all batches, as a scalar of the plan."""
    paths = [f"{base}/references/batch={n}" for n in _numbers(spark, base, "deltas", "batch")]
    return spark.read.parquet(*paths).select(reference_date(F.max("latest"))).scalar()


def as_rfm(sums: DataFrame, reference: Column) -> DataFrame:
    """(customer_unique_id, recency, frequency, monetary) as of the reference date."""
    return sums.select("customer_unique_id", recency_days(reference, F.col("latest")).alias("recency"), "frequency", "monetary")


def fold(spark: SparkSession, base: str) -> int:
    """Merge all complete batches into one table; returns the last of them. Older parts stay until they are deleted by hand."""
    last = _numbers(spark, base, "deltas", "batch")[-1]
    target = f"{base}/folded/upto={last}"
    if not _complete(spark, target):
        customer_sums(spark, base).write.mode("overwrite").parquet(target)
    return last
