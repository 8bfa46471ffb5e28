"""Marketplace views over the TPC-H-like test tables.

The same definitions exist as SQL text in ``plans/oracle.py``; both sides are
lazy, so filters and column pruning reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlens.schemas import EVENTS
from bazarlens.sources.tables import Marketplace

# Lexical signals for the invented prose of the test documents, same shape as
# the Portuguese table: unigrams, bigrams and trigrams per label.
PROXY_SIGNALS = {
    "Logistica_Retrasos": ["idiot", "clown", "of the", "is the that"],
    "Calidad_Producto": ["trash", "worthless", "disgusting", "on the"],
    "Producto_Incorrecto_Faltante": ["loser", "with the", "is the"],
    "Reembolso_Atencion_Cliente": ["pathetic", "stupid", "der die", "and the in"],
    "Problema_Fiscal_Burocracia": ["scum", "moron", "les des", "in the to"],
}


# Given schemas: no job is spent on reading file footers for them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "events": EVENTS,
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def orders_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        # Nested, so that a filter on one status reduces to a filter on the column.
        F.when(status == "F", "delivered")
        .otherwise(F.when(status == "O", "shipped").otherwise("processing"))
        .alias("order_status"),
    )


def items_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("freight_value"),
    )


def products_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.nullif(F.col("p_brand"), F.lit("Brand#7")).alias("product_category_name"),
    )


def translation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    return (
        read_table(spark, sf_dir, "part")
        .filter(~brand.like("%5") & (brand != "Brand#7"))
        .select(
            brand.alias("product_category_name"),
            F.concat(F.lit("en_"), F.lower(brand)).alias("product_category_name_english"),
        )
        .distinct()
    )


def reviews_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        F.col("doc_id").alias("order_id"),
        F.col("text").alias("review_comment_message"),
        F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).when(F.col("quality") == 1, 5).alias("review_score"),
    )


def review_scores_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews without their text, for queries that never read it."""
    return reviews_p(spark, sf_dir).select("review_id", "order_id", "review_score")


def customers_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return (
        read_table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("n_name").alias("customer_city"),
            F.col("r_name").alias("customer_state"),
            (F.col("c_custkey") % 97).alias("customer_zip_code_prefix"),
        )
    )


def sellers_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    return (
        read_table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_city"))
    )


def geolocation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    zip_code = key % 97
    return (
        read_table(spark, sf_dir, "customer")
        .filter(~zip_code.isin(89, 93, 96))
        .select(
            zip_code.alias("geolocation_zip_code_prefix"),
            F.when(zip_code == 50, F.lit(40.0))
            .otherwise(F.lit(-24.0) + (key * 31 % 1000) / F.lit(1000.0))
            .alias("geolocation_lat"),
            (F.lit(-47.0) + (key * 17 % 1000) / F.lit(1000.0)).alias("geolocation_lng"),
        )
    )


def events_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour events with the product taken out of the JSON properties."""
    return with_product(read_table(spark, sf_dir, "events"))


def with_product(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("customer_id"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("product_id"),
    )


def marketplace(spark: SparkSession, sf_dir: str) -> Marketplace:
    """All proxy views as one marketplace."""
    return Marketplace(
        orders=orders_p(spark, sf_dir),
        items=items_p(spark, sf_dir),
        products=products_p(spark, sf_dir),
        translation=translation_p(spark, sf_dir),
        reviews=reviews_p(spark, sf_dir),
        customers=customers_p(spark, sf_dir),
        geolocation=geolocation_p(spark, sf_dir),
    )
