"""Complaint corpus and dissatisfaction rates per product category.

A review counts once for every item of its order, in the numerator and in the
denominator. The rates get that fan-out by multiplying two per-order counts,
so an order with very many items and reviews never expands into pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.fixed_values import DELIVERY_PAINS, PAIN_ORDER
from bazarlens.functions.scalars import pct_rate
from bazarlens.operators.sales import product_categories

BAD_SCORES = (1, 2)
MIN_REVIEWS = 100


def filter_bad_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with one or two stars and a text."""
    return reviews.filter(F.col("review_score").isin(*BAD_SCORES) & F.col("review_comment_message").isNotNull())


def review_items(reviews: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Row-level join: one row per (review, item) with the category.

    Products without an entry keep their row under the fallback name.
    """
    joined = reviews.join(items.select("order_id", "product_id"), "order_id")
    named = joined.join(product_categories(products, translation), "product_id", "left")
    return named.withColumn("categoria", F.coalesce("categoria", F.lit("unknown_category")))


def order_category_items(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """(order_id, categoria, n_items); items are counted per product before they meet the dimension."""
    per_product = items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    named = per_product.join(product_categories(products, translation), "product_id", "left")
    return named.groupBy("order_id", F.coalesce("categoria", F.lit("unknown_category")).alias("categoria")).agg(F.sum("n").alias("n_items"))


def category_pain_counts(
    reviews: DataFrame,
    classified: DataFrame,
    items: DataFrame,
    products: DataFrame,
    translation: DataFrame,
) -> DataFrame:
    """(categoria, pain, n): review x item rows; ``pain`` null = all reviews.

    Totals and complaints go through one join: everything below is derived
    from this frame, which has a row per category and label. Complaints are
    reviews, so only items of reviewed orders are moved and named.
    """
    everything = reviews.select("order_id", "review_id", F.lit(None).cast("string").alias("pain"))
    complaints = classified.select("order_id", "review_id", F.col("pain_point_category").alias("pain"))
    per_order = (
        everything.unionByName(complaints)
        .filter(F.col("review_id").isNotNull())
        .groupBy("order_id", "pain")
        .agg(F.count("review_id").alias("n_reviews"))
    )
    reviewed = items.select("order_id", "product_id").join(reviews.select("order_id"), "order_id", "left_semi")
    return (
        per_order.join(order_category_items(reviewed, products, translation), "order_id")
        .groupBy("categoria", "pain")
        .agg(F.sum(F.col("n_reviews") * F.col("n_items")).alias("n"))
    )


def reviews_by_category(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("pain").isNull()).select("categoria", F.col("n").alias("total_resenas"))


def bad_reviews_by_category(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("pain").isNotNull()).groupBy("categoria").agg(F.sum("n").alias("resenas_negativas"))


def join_rate(counts: DataFrame) -> DataFrame:
    """Totals with their complaints; zero where a category has none.

    Equal to a left join of two aggregates, done as one conditional aggregate.
    """
    total = F.sum(F.when(F.col("pain").isNull(), F.col("n")))
    bad = F.coalesce(F.sum(F.when(F.col("pain").isNotNull(), F.col("n"))), F.lit(0))
    rates = counts.groupBy("categoria").agg(total.alias("total_resenas"), bad.alias("resenas_negativas"))
    return rates.filter(F.col("total_resenas").isNotNull()).withColumn(
        "tasa_insatisfaccion", pct_rate(F.col("resenas_negativas"), F.col("total_resenas"))
    )


def dissatisfaction_rate(counts: DataFrame, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    """Categories with enough reviews, worst rate first (ties: name).

    Ordered by the rate rounded to one digit, as it is reported.
    """
    return (
        join_rate(counts)
        .filter(F.col("total_resenas") >= min_reviews)
        .orderBy(F.desc(F.bround("tasa_insatisfaccion", 1)), F.asc("categoria"))
    )


def eligible_counts(counts: DataFrame, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    return join_rate(counts).agg(
        F.count_if(F.col("total_resenas") >= min_reviews).alias("n_eligible"), F.count(F.lit(1)).alias("n_total")
    )


def join_pain_rate(counts: DataFrame, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    """Rate of every label within every category with enough reviews."""
    totals = reviews_by_category(counts).filter(F.col("total_resenas") >= min_reviews)
    per_pain = counts.filter(F.col("pain").isNotNull()).select("categoria", "pain", F.col("n").alias("resenas_negativas_pain"))
    return totals.join(per_pain, "categoria").withColumn(
        "tasa", pct_rate(F.col("resenas_negativas_pain"), F.col("total_resenas"))
    )


def top_k_per_pain(counts: DataFrame, min_reviews: int = MIN_REVIEWS, k: int = 5) -> DataFrame:
    """The k worst categories of each reported label, in one pass.

    Ranked by the rate rounded to one digit, ties by name.
    """
    order = Window.partitionBy("pain").orderBy(F.desc(F.bround("tasa", 1)), F.asc("categoria"))
    return (
        join_pain_rate(counts, min_reviews)
        .filter(F.col("pain").isin(PAIN_ORDER))
        .withColumn("posicion", F.row_number().over(order).cast("long"))
        .filter(F.col("posicion") <= k)
    )


def pain_multi_top(counts: DataFrame, min_reviews: int = MIN_REVIEWS, k: int = 5, at_least: int = 3) -> DataFrame:
    """Categories that are among the worst of several labels."""
    return (
        top_k_per_pain(counts, min_reviews, k)
        .groupBy("categoria")
        .agg(F.count(F.lit(1)).alias("n_pains"))
        .filter(F.col("n_pains") >= at_least)
    )


def pain_distribution(classified: DataFrame) -> DataFrame:
    """Complaints and share per label; the window runs over the six labels."""
    counts = classified.groupBy("pain_point_category").agg(F.count(F.lit(1)).alias("quejas"))
    total = F.sum("quejas").over(Window.partitionBy())
    return counts.withColumn("pct", pct_rate(F.col("quejas"), total)).orderBy(F.desc("quejas"), F.asc("pain_point_category"))


def combined_share(classified: DataFrame, labels: list[str] = DELIVERY_PAINS) -> DataFrame:
    """Share of each named label and of all of them together."""
    label = F.col("pain_point_category")
    total = F.count(F.lit(1))
    shares = [pct_rate(F.count_if(label == name), total).alias(f"pct_{i + 1}") for i, name in enumerate(labels)]
    return classified.agg(total.alias("n_quejas"), *shares, pct_rate(F.count_if(label.isin(*labels)), total).alias("pct_combined"))
