"""Product knowledge base: curated texts joined with real prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazarlens.fixed_values import CATALOG_DESCRIPTION, CATALOG_VERSION, CURATED_PRODUCTS

CURATED_SCHEMA = "id string, categoria string, nombre string, descripcion string, destacado boolean, tags array<string>"


def curated_products(spark: SparkSession) -> DataFrame:
    """The hand-written entries: name, text, flag and tags per category."""
    return spark.createDataFrame(CURATED_PRODUCTS, CURATED_SCHEMA)


def price_stats(sales: DataFrame) -> DataFrame:
    """Average, least and largest price and units of each category."""
    return sales.select(
        "categoria",
        F.col("avg_price").alias("precio_promedio"),
        F.col("min_price").alias("minimo"),
        F.col("max_price").alias("maximo"),
        F.col("units").alias("unidades_vendidas"),
    )


def featured_categories(sales: DataFrame, k: int = 3) -> DataFrame:
    """Categories worth a curated entry: best by revenue, then by units.

    The windows run over one row per category.
    """
    by_revenue = F.row_number().over(Window.orderBy(F.desc("revenue"), F.asc("categoria")))
    by_units = F.row_number().over(Window.orderBy(F.desc("units"), F.asc("categoria")))
    ranked = sales.select("categoria", by_revenue.cast("long").alias("rank_revenue"), by_units.cast("long").alias("rank_units"))
    return ranked.orderBy(F.least("rank_revenue", "rank_units"), F.asc("rank_revenue"), F.asc("categoria")).limit(k)


def catalog_products(curated: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per curated product in the shape of the document."""
    return curated.join(stats, "categoria").select(
        "id",
        "categoria",
        "nombre",
        "descripcion",
        F.round("precio_promedio", 2).alias("precio_promedio_real"),
        F.struct("minimo", "maximo").alias("rango_precios"),
        "unidades_vendidas",
        "destacado",
        "tags",
    )


def catalog_doc(products: DataFrame, version: str = CATALOG_VERSION, description: str = CATALOG_DESCRIPTION) -> DataFrame:
    """The whole knowledge base as one nested row, products by id.

    A document is one row, as large as the hand-written list it is made of;
    :func:`catalog_products` has the same content with a row per product.
    """
    document = products.agg(
        F.count(F.lit(1)).alias("total_productos"), F.sort_array(F.collect_list(F.struct(*products.columns))).alias("productos")
    )
    return document.select(F.lit(version).alias("version"), F.lit(description).alias("descripcion"), "total_productos", "productos")


def catalog_filter(
    products: DataFrame,
    tag: str | None = None,
    price_between: tuple[float, float] | None = None,
    featured: bool | None = None,
) -> DataFrame:
    """Products by tag, average price range and featured flag."""
    kept: Column = F.lit(True)
    if tag is not None:
        kept = kept & F.array_contains("tags", tag)
    if price_between is not None:
        kept = kept & F.col("precio_promedio_real").between(*price_between)
    if featured is not None:
        kept = kept & (F.col("destacado") == featured)
    return products.filter(kept)
