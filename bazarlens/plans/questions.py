"""The business questions end to end, on any :class:`Marketplace`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlens.operators import catalog, cluster, complaints, context, geo, ngrams, recommend, reviews, rfm, sales
from bazarlens.functions.text import clean_tokens
from bazarlens.session import materialize
from bazarlens.sources.tables import Marketplace


def best_sellers(m: Marketplace, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Question 1: top categories by units and by revenue."""
    totals = sales.category_sales(m.orders, m.items, m.products, m.translation)
    return sales.top_categories_by_units(totals, k), sales.top_categories_by_revenue(totals, k)


@dataclass(frozen=True)
class ComplaintReport:
    distribution: DataFrame
    delivery_share: DataFrame
    rates: DataFrame
    per_pain: DataFrame
    multi_pain: DataFrame
    top_terms: DataFrame


def complaint_report(
    m: Marketplace,
    classifier: Callable[[DataFrame], DataFrame] = complaints.classify_by_signals,
    min_reviews: int = reviews.MIN_REVIEWS,
) -> ComplaintReport:
    """Question 2: what hurts, how often, and in which categories."""
    corpus = reviews.filter_bad_reviews(m.reviews)
    classified = materialize(classifier(corpus), "classified")
    counts = materialize(reviews.category_pain_counts(m.reviews, classified, m.items, m.products, m.translation), "pain-counts")
    tokens = corpus.select(clean_tokens(F.col("review_comment_message")).alias("tokens"))
    return ComplaintReport(
        distribution=reviews.pain_distribution(classified),
        delivery_share=reviews.combined_share(classified),
        rates=reviews.dissatisfaction_rate(counts, min_reviews),
        per_pain=reviews.top_k_per_pain(counts, min_reviews),
        multi_pain=reviews.pain_multi_top(counts, min_reviews),
        top_terms=ngrams.top_ngrams(ngrams.ngram_counts(tokens)),
    )


def customer_segments(m: Marketplace, restarts: int = cluster.RESTARTS) -> DataFrame:
    """Question 3: loyal, at risk, sleeping and sporadic customers."""
    return cluster.segment_customers(rfm.rfm(m.orders, m.items, m.customers), restarts)


@dataclass(frozen=True)
class LocationReport:
    cities: DataFrame
    centroid: DataFrame
    coverage: DataFrame
    matches: DataFrame
    national: DataFrame


def store_location(m: Marketplace) -> LocationReport:
    """Question 5: the best city, its revenue-weighted centre and the coverage.

    The best city enters the later steps as a scalar subquery.
    """
    accounts = materialize(rfm.customer_accounts(m.orders, m.items, m.customers), "accounts")
    stats = geo.city_stats(accounts)
    city = geo.best_city(stats).select("customer_city").scalar()
    totals = materialize(geo.zip_totals(accounts), "zip-totals")
    centroids = geo.zip_centroid(m.geolocation)
    chosen = geo.in_city(totals, city)
    points = geo.located(chosen, centroids)
    center = geo.weighted_centroid(points)
    return LocationReport(
        cities=geo.top_cities(stats),
        centroid=geo.centroid_shift(center),
        coverage=geo.coverage_stats(points, center),
        matches=geo.match_coverage(chosen, centroids),
        national=geo.city_geo(geo.located(totals, centroids)),
    )


def knowledge_base(m: Marketplace, curated: DataFrame | None = None) -> DataFrame:
    """Question 6: the curated product document with real prices."""
    totals = sales.category_sales(m.orders, m.items, m.products, m.translation)
    texts = curated if curated is not None else catalog.curated_products(m.orders.sparkSession)
    return catalog.catalog_doc(catalog.catalog_products(texts, catalog.price_stats(totals)))


def agent_prompts(
    m: Marketplace, segmented: DataFrame, classified: DataFrame, products: DataFrame, crm: DataFrame | None = None
) -> DataFrame:
    """Question 7: the rendered system prompt of every customer."""
    latest = context.customer_complaint(classified, m.orders, m.customers)
    return context.render_context(context.customer_profiles(segmented, latest, crm), products)


def recommendations(
    m: Marketplace,
    product_features: DataFrame,
    segments: DataFrame,
    k: int = 10,
    pool_size: int = 100,
    implicit: DataFrame | None = None,
    implicit_share: float = 0.0,
) -> DataFrame:
    """Question 4: precomputed top k of every customer, from the pool of its segment (customer, segmento)."""
    bought = materialize(recommend.purchases(m.orders, m.items, m.customers), "purchases")
    pool = materialize(recommend.candidate_pool(bought, segments, size=pool_size), "pool")
    everyone = m.customers.select(F.col("customer_unique_id").alias("customer")).distinct()
    routes = materialize(recommend.recommend_route(everyone, bought), "routes")
    return recommend.recommend(routes, bought, segments, pool, product_features, recommend.product_popularity(bought), k, implicit, implicit_share)
