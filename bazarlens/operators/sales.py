"""Sold items: filters, joins, totals and rankings per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.functions.scalars import category_fallback
from bazarlens.operators.profiling import top_k

SOLD = "delivered"


def filter_delivered(orders: DataFrame, status: str = SOLD) -> DataFrame:
    return orders.filter(F.col("order_status") == status)


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """(product_id, categoria): two dimension tables, joined once."""
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        category_fallback(F.col("product_category_name_english"), F.col("product_category_name")).alias("categoria"),
    )


def sales_items(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """The sold-item fact: one row per delivered item with its category."""
    return (
        filter_delivered(orders)
        .select("order_id", "customer_id")
        .join(items.select("order_id", "product_id", "price"), "order_id")
        .join(product_categories(products, translation), "product_id")
    )


def order_revenue(items: DataFrame, name: str = "revenue") -> DataFrame:
    """Revenue per order: sum of prices, freight left out."""
    return items.groupBy("order_id").agg(F.sum("price").alias(name))


def product_sales(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Sold units and prices per product.

    Grouping by product before any dimension join means that a best seller
    travels as one partial row per task, and the joins see one row a product.
    """
    sold = filter_delivered(orders).select("order_id").join(items.select("order_id", "product_id", "price"), "order_id")
    return sold.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.count("price").alias("priced_units"),
        F.sum("price").alias("revenue"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


def category_sales(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Units, revenue and price range per category, from the product totals."""
    per_product = product_sales(orders, items).join(product_categories(products, translation), "product_id")
    return per_product.groupBy("categoria").agg(
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.try_divide(F.sum("revenue"), F.sum("priced_units")).alias("avg_price"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
    )


def top_categories_by_units(sales: DataFrame, k: int = 5) -> DataFrame:
    ranked = top_k(sales, [F.desc("units"), F.asc("categoria")], k)
    return ranked.select(F.col("categoria").alias("categoria_producto_final"), F.col("units").alias("volumen_total"))


def top_categories_by_revenue(sales: DataFrame, k: int = 5) -> DataFrame:
    ranked = top_k(sales, [F.desc("revenue"), F.asc("categoria")], k)
    return ranked.select(F.col("categoria").alias("categoria_producto_final"), F.col("revenue").alias("ingreso_total"))


def ticket_gap(sales: DataFrame) -> DataFrame:
    """Rank by units against rank by revenue, with the average ticket.

    The windows run over one row per category.
    """
    by_units = F.rank().over(Window.orderBy(F.desc("units")))
    by_revenue = F.rank().over(Window.orderBy(F.desc("revenue")))
    ranked = sales.select(
        "categoria", "avg_price", by_units.cast("long").alias("rank_units"), by_revenue.cast("long").alias("rank_revenue")
    )
    return ranked.withColumn("rank_gain", F.col("rank_units") - F.col("rank_revenue"))
