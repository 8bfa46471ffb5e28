"""Recency, frequency and spend per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlens.functions.scalars import pct_rate, recency_days, reference_date
from bazarlens.operators.sales import filter_delivered, order_revenue


def account_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Delivered orders combined per customer account.

    Done before any customer join: the join needs the same partitioning and so
    adds no shuffle, and an account with very many orders is one row in it.
    """
    delivered = filter_delivered(orders).select("order_id", "customer_id", "order_purchase_timestamp")
    return (
        delivered.join(order_revenue(items, "ingresos"), "order_id")
        .groupBy("customer_id")
        .agg(
            F.max("order_purchase_timestamp").alias("latest"),
            F.count("order_id").alias("n_orders"),
            F.sum("ingresos").alias("ingresos"),
        )
    )


def customer_accounts(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """Account totals with the person, city, state and zip of the account."""
    return account_totals(orders, items).join(customers, "customer_id")


def rfm(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """(customer_unique_id, recency, frequency, monetary) of delivered orders.

    The reference date looks at all delivered orders, also those without items.
    """
    reference = filter_delivered(orders).select(reference_date(F.max("order_purchase_timestamp"))).scalar()
    per_person = (
        customer_accounts(orders, items, customers)
        .filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.max("latest").alias("latest"), F.sum("n_orders").alias("frequency"), F.sum("ingresos").alias("monetary"))
    )
    return per_person.select(
        "customer_unique_id", recency_days(reference, F.col("latest")).alias("recency"), "frequency", "monetary"
    )


def customer_orders(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per delivered order with its revenue, person, city and zip."""
    return (
        filter_delivered(orders)
        .select("order_id", "customer_id", "order_purchase_timestamp")
        .join(order_revenue(items, "ingresos"), "order_id")
        .join(customers, "customer_id")
    )


def frequency_split(rfm_table: DataFrame) -> DataFrame:
    """Customers and share with one, two or more, three or more orders."""
    total = F.count(F.lit(1))
    tests = [("freq=1", F.col("frequency") == 1), ("freq>=2", F.col("frequency") >= 2), ("freq>=3", F.col("frequency") >= 3)]
    wide = rfm_table.agg(total.alias("total"), *[F.count_if(test).alias(name) for name, test in tests])
    rows = [
        F.struct(F.lit(name).alias("grupo"), F.col(f"`{name}`").alias("clientes"), pct_rate(F.col(f"`{name}`"), F.col("total")).alias("pct"))
        for name, _ in tests
    ]
    return wide.select(F.inline(F.array(*rows)))
