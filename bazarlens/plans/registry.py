"""One query per operator over the test tables, keyed by operator name.

Every query reads whole tables. Frames that feed several jobs are written to
the shared folder first. Rates and sums are rounded only for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlens.fixed_values import TAXONOMY
from bazarlens.functions import scalars, text
from bazarlens.operators import (
    catalog,
    cluster,
    complaints,
    context,
    feedback,
    geo,
    ngrams,
    profiling,
    recommend,
    reviews,
    rfm,
    rfm_state,
    sales,
)
from bazarlens.plans import questions
from bazarlens.session import fresh_path, materialize
from bazarlens.sources import documents, proxies, tables
from bazarlens.streaming import complaints as stream_complaints
from bazarlens.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MIN_REVIEWS = 20
SCALED = ["recency_s", "monetary_s"]
# Frozen centres (scaled recency, scaled spend) for checks of fixed assignments.
CENTROIDS = [(0, (0.0, 0.0)), (1, (0.0, 1.5))]
CENTROIDS_3 = [(0, (0.0, 0.0)), (1, (0.0, 1.5)), (2, (1.5, 0.0))]
WEIGHTS = {"purchase": 1.0, "click": 0.3, "view": 0.1}
# Weight of the interactions beside the similarities.
IMPLICIT_SHARE = 0.01


def query(function: Query) -> Query:
    QUERIES[function.__name__.lstrip("_")] = function
    return function


def rnd(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def stamp(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- shared inputs --------------------------------------------------------------


def _category_sales(spark: SparkSession, sf: str) -> DataFrame:
    return sales.category_sales(
        proxies.orders_p(spark, sf), proxies.items_p(spark, sf), proxies.products_p(spark, sf), proxies.translation_p(spark, sf)
    )


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.filter_bad_reviews(proxies.reviews_p(spark, sf))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return complaints.classify_by_signals(_corpus(spark, sf), proxies.PROXY_SIGNALS)


def _pain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.category_pain_counts(
        proxies.review_scores_p(spark, sf),
        _classified(spark, sf),
        proxies.items_p(spark, sf),
        proxies.products_p(spark, sf),
        proxies.translation_p(spark, sf),
    )


def _rfm(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.rfm(proxies.orders_p(spark, sf), proxies.items_p(spark, sf), proxies.customers_p(spark, sf))


def _scaled(spark: SparkSession, sf: str, recurrent: bool | None = True) -> DataFrame:
    """Scaled customers; written once since the quantiles pass over them twice."""
    base = materialize(_rfm(spark, sf), "rfm")
    if recurrent is not None:
        base = base.filter(F.col("frequency") >= 2 if recurrent else F.col("frequency") == 1)
    return cluster.robust_scale(base, ["recency", "monetary"])


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Segments from frozen centres: the label rules without a seeded fit."""
    parts = []
    base = materialize(_rfm(spark, sf), "rfm")
    for recurrent in (True, False):
        group = base.filter(F.col("frequency") >= 2 if recurrent else F.col("frequency") == 1)
        scaled = cluster.robust_scale(group, ["recency", "monetary"])
        parts.append(cluster.label_group(scaled, CENTROIDS, recurrent))
    return cluster.union_segments(*parts)


def _order_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.customer_orders(proxies.orders_p(spark, sf), proxies.items_p(spark, sf), proxies.customers_p(spark, sf))


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.customer_accounts(proxies.orders_p(spark, sf), proxies.items_p(spark, sf), proxies.customers_p(spark, sf))


def _zip_totals(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(geo.zip_totals(_accounts(spark, sf)), "zip-totals")


def _best_city(totals: DataFrame) -> Column:
    """Name of the city with the largest revenue, from the zip totals."""
    per_city = totals.groupBy("customer_city", "customer_state").agg(F.sum("ingresos").alias("ingresos_totales"))
    return geo.best_city(per_city).select("customer_city").scalar()


def _city_points(spark: SparkSession, sf: str) -> DataFrame:
    totals = _zip_totals(spark, sf)
    return geo.located(geo.in_city(totals, _best_city(totals)), geo.zip_centroid(proxies.geolocation_p(spark, sf)))


def _all_points(spark: SparkSession, sf: str) -> DataFrame:
    totals = _zip_totals(spark, sf)
    return geo.located(totals, geo.zip_centroid(proxies.geolocation_p(spark, sf)))


def _curated(spark: SparkSession, sf: str, totals: DataFrame) -> DataFrame:
    """Curated entries of the featured categories, texts derived from the data."""
    chosen = catalog.featured_categories(totals)
    name = F.col("categoria")
    return chosen.select(
        F.concat(F.lit("PROD-"), F.regexp_replace(name, r"\D", "")).alias("id"),
        "categoria",
        F.concat(F.lit("Seleccion "), name).alias("nombre"),
        F.concat(F.lit('Lo mejor de "'), name, F.lit('"')).alias("descripcion"),
        (F.length(name) % 2 == 0).alias("destacado"),
        F.array(name, F.lit("hogar"), F.lit("regalo")).alias("tags"),
    )


def _catalog_products(spark: SparkSession, sf: str) -> DataFrame:
    totals = materialize(_category_sales(spark, sf), "category-sales")
    return catalog.catalog_products(_curated(spark, sf, totals), catalog.price_stats(totals))


def _latest_complaints(spark: SparkSession, sf: str) -> DataFrame:
    classified = materialize(_classified(spark, sf), "classified")
    return context.customer_complaint(classified, proxies.orders_p(spark, sf), proxies.customers_p(spark, sf))


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return context.customer_profiles(
        _labelled(spark, sf), _latest_complaints(spark, sf), medium_from=100_000.0, high_from=400_000.0, recent_days=365
    )


def _purchases(spark: SparkSession, sf: str) -> DataFrame:
    bought = recommend.purchases(proxies.orders_p(spark, sf), proxies.items_p(spark, sf), proxies.customers_p(spark, sf))
    return materialize(bought, "purchases")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: it is read for the pools and again for the ranking."""
    split = F.when(F.col("frequency") >= 2, "recurrente").otherwise("unico")
    return materialize(_rfm(spark, sf).select(F.col("customer_unique_id").alias("customer"), split.alias("segmento")), "segments")


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.product_ratings(proxies.review_scores_p(spark, sf), proxies.items_p(spark, sf))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("product"),
        F.col("p_brand").alias("categoria"),
        F.col("p_retailprice").alias("price"),
        F.array("p_type", F.col("p_size").cast("string")).alias("traits"),
    )


def _served(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "view").select(F.col("event_id").alias("served_id"), "customer_id", "product_id", "ts")


def _actions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin("click", "purchase")).select(
        F.col("event_id").alias("action_id"), "customer_id", "product_id", "ts", F.col("event_type").alias("action")
    )


# --- sources, sinks, profiles ---------------------------------------------------


@query
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews through CSV files: quotes and line ends inside the text survive."""
    path = fresh_path(spark, "reviews-csv")
    tables.write_csv(proxies.reviews_p(spark, sf), path)
    schema = "review_id long, order_id long, review_comment_message string, review_score int"
    loaded = tables.read_csv(spark, path, schema)
    return loaded.select("review_id", "order_id", "review_score", F.md5("review_comment_message").alias("text_md5"))


@query
def load_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Row count and number of columns of every table of the star schema."""
    m = proxies.marketplace(spark, sf)
    parts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(frame.columns)).cast("long").alias("n_columns")
        )
        for name, frame in [*vars(m).items(), ("sellers", proxies.sellers_p(spark, sf))]
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    named = [("orders", proxies.orders_p), ("products", proxies.products_p), ("reviews", proxies.reviews_p), ("sellers", proxies.sellers_p)]
    out = None
    for name, view in named:
        part = profiling.profile_table(view(spark, sf), name).select("table_name", "column_name", "n_rows", "n_null")
        out = part if out is None else out.unionByName(part)
    return out


@query
def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    table = materialize(_rfm(spark, sf), "rfm")
    summary = profiling.describe_numeric(table, ["recency", "frequency", "monetary"])
    return summary.select("column_name", "n", *[rnd(c, 4) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.value_counts(proxies.orders_p(spark, sf), "order_status")


@query
def sink_table(spark: SparkSession, sf: str) -> DataFrame:
    """The segmented customers written as a table partitioned by segment."""
    path = fresh_path(spark, "segmented")
    tables.write_table(_labelled(spark, sf), path, partition_by=["segmento"])
    return spark.read.parquet(path).select("customer_unique_id", "recency", "frequency", rnd("monetary", 2), "segmento")


@query
def sink_json_doc(spark: SparkSession, sf: str) -> DataFrame:
    """The knowledge base as one JSON document, its fields read back by path."""
    document = catalog.catalog_doc(_catalog_products(spark, sf)).select(F.to_json(F.struct("*")).alias("doc"))
    return document.select(
        F.get_json_object("doc", "$.version").alias("version"),
        F.get_json_object("doc", "$.total_productos").cast("long").alias("total_productos"),
        F.get_json_object("doc", "$.productos[0].id").alias("first_id"),
        F.get_json_object("doc", "$.productos[0].rango_precios.minimo").cast("double").alias("first_min"),
        F.get_json_object("doc", "$.productos[0].tags[1]").alias("first_tag"),
    )


@query
def scan_json_doc(spark: SparkSession, sf: str) -> DataFrame:
    """The document written as a JSON file and read as one row per product."""
    path = fresh_path(spark, "catalog-json")
    documents.write_json_document(catalog.catalog_doc(_catalog_products(spark, sf)), path)
    products = documents.read_catalog(spark, path)
    return products.select(
        "id", "categoria", "nombre", "descripcion", "precio_promedio_real",
        F.col("rango_precios.minimo").alias("minimo"), F.col("rango_precios.maximo").alias("maximo"),
        "unidades_vendidas", "destacado", F.array_join("tags", "|").alias("tags"),
    )


@query
def classify_resume(spark: SparkSession, sf: str) -> DataFrame:
    """A first run on the one-star reviews, then a run on all: each once."""
    path = fresh_path(spark, "classified")

    def classifier(pending: DataFrame) -> DataFrame:
        return complaints.classify_by_signals(pending, proxies.PROXY_SIGNALS)

    corpus = _corpus(spark, sf)
    complaints.classify_resume(corpus.filter(F.col("review_score") == 1), path, classifier)
    done = complaints.classify_resume(corpus, path, classifier, slices=2)
    return done.select("review_id", "review_score", "pain_point_category")


# --- projections and scalar functions -------------------------------------------


@query
def filter_delivered(spark: SparkSession, sf: str) -> DataFrame:
    sold = sales.filter_delivered(proxies.orders_p(spark, sf))
    return sold.select("order_id", "customer_id", stamp(F.col("order_purchase_timestamp")).alias("purchased_at"))


@query
def filter_bad_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf).select("review_id", "order_id", "review_score", F.length("review_comment_message").cast("long").alias("n_chars"))


@query
def project_columns(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.items_p(spark, sf).select("order_id", "product_id")


@query
def category_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return sales.product_categories(proxies.products_p(spark, sf), proxies.translation_p(spark, sf))


@query
def fill_zero_int(spark: SparkSession, sf: str) -> DataFrame:
    """Bad reviews per order, zero for orders without one."""
    bad = _corpus(spark, sf).groupBy("order_id").agg(F.count("review_id").alias("n"))
    orders = proxies.orders_p(spark, sf).select("order_id")
    return orders.join(bad, "order_id", "left").select("order_id", scalars.fill_zero_int(F.col("n")).alias("n_bad"))


@query
def parse_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """Text to timestamp and the day after."""
    texts = proxies.orders_p(spark, sf).select("order_id", stamp(F.col("order_purchase_timestamp")).alias("text"))
    parsed = F.to_timestamp_ntz("text", F.lit("yyyy-MM-dd HH:mm:ss"))
    return texts.select("order_id", "text", stamp(scalars.reference_date(parsed)).alias("next_day"))


@query
def recency_days(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days from each event to the day after the last one."""
    events = proxies.events_p(spark, sf)
    reference = events.select(scalars.reference_date(F.max("ts"))).scalar()
    return events.select("event_id", scalars.recency_days(reference, F.col("ts")).alias("recency"))


@query
def pct_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each order status."""
    counts = profiling.value_counts(proxies.orders_p(spark, sf), "order_status")
    total = counts.select(F.sum("n")).scalar()
    return counts.select("order_status", F.round(scalars.pct_rate(F.col("n"), total), 6).alias("pct"))


@query
def map_labels(spark: SparkSession, sf: str) -> DataFrame:
    scaled = _scaled(spark, sf)
    assigned = cluster.kmeans_assign(scaled, SCALED, CENTROIDS)
    labels = cluster.recurrent_labels(cluster.cluster_stats(assigned))
    return cluster.map_labels(assigned, labels).select("customer_unique_id", "cluster", "segmento")


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = complaints.cleaned_corpus(proxies.reviews_p(spark, sf))
    return cleaned.select("review_id", F.length("texto_limpio").cast("long").alias("n_chars"), F.md5("texto_limpio").alias("clean_md5"))


@query
def text_length_rank(spark: SparkSession, sf: str) -> DataFrame:
    return complaints.longest_texts(complaints.cleaned_corpus(_corpus(spark, sf)), 3)


@query
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    message = F.col("review_comment_message")
    return proxies.reviews_p(spark, sf).select(
        "review_id", text.truncate_text(message, 100).alias("first_100"), text.truncate_text(message, 120).alias("first_120")
    )


@query
def parse_label(spark: SparkSession, sf: str) -> DataFrame:
    """Answers made of text and label, in other case, with text around."""
    answer = F.concat("review_comment_message", F.lit(" -> "), F.when(F.col("review_id") % 3 == 0, F.lit("??")).otherwise(F.upper("pain_point_category")))
    return _classified(spark, sf).select("review_id", text.parse_label(answer).alias("label"))


@query
def render_classify_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt = text.classify_prompt(F.concat(F.lit("  "), "review_comment_message", F.lit("\n ")))
    return _corpus(spark, sf).select("review_id", F.length(prompt).cast("long").alias("n_chars"), F.md5(prompt).alias("prompt_md5"))


@query
def signal_match(spark: SparkSession, sf: str) -> DataFrame:
    return complaints.signal_rows(complaints.signal_match(_corpus(spark, sf), proxies.PROXY_SIGNALS), proxies.PROXY_SIGNALS)


@query
def signal_stats(spark: SparkSession, sf: str) -> DataFrame:
    return complaints.signal_stats(_corpus(spark, sf), proxies.PROXY_SIGNALS)


@query
def signal_stats_default(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the default signals of the library."""
    return complaints.signal_stats(_corpus(spark, sf))


@query
def geo_bounds(spark: SparkSession, sf: str) -> DataFrame:
    points = proxies.geolocation_p(spark, sf)
    valid = scalars.geo_valid(F.col("geolocation_lat"), F.col("geolocation_lng"))
    return points.groupBy("geolocation_zip_code_prefix").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"))


@query
def planar_km(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every zip centre to a fixed point."""
    centers = geo.zip_centroid(proxies.geolocation_p(spark, sf))
    km = scalars.planar_km(F.col("lat"), F.col("lng"), F.lit(-23.5), F.lit(-46.6))
    return centers.select("zip", F.round(km, 6).alias("km"))


@query
def circle_radius(spark: SparkSession, sf: str) -> DataFrame:
    totals = _zip_totals(spark, sf)
    cities = geo.city_geo(geo.located(totals, geo.zip_centroid(proxies.geolocation_p(spark, sf))))
    return geo.circles(cities, _best_city(totals)).select("customer_city", "customer_state", rnd("ingresos", 2), rnd("radio_m", 4), "es_top")


@query
def title_case(spark: SparkSession, sf: str) -> DataFrame:
    """City names in title and upper case, over all customers."""
    city = F.col("customer_city")
    return (
        proxies.customers_p(spark, sf)
        .groupBy(scalars.title_case(F.lower(city)).alias("title"), F.upper(city).alias("upper"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def history_text(spark: SparkSession, sf: str) -> DataFrame:
    table = context.with_history(_rfm(spark, sf), 100_000.0, 400_000.0)
    return table.select("customer_unique_id", "historial_compras")


@query
def order_status_text(spark: SparkSession, sf: str) -> DataFrame:
    return context.with_history(_rfm(spark, sf), recent_days=365).select("customer_unique_id", "orden_status")


@query
def scenario_route(spark: SparkSession, sf: str) -> DataFrame:
    return _profiles(spark, sf).select("customer_unique_id", "persona")


@query
def profile_json(spark: SparkSession, sf: str) -> DataFrame:
    profile = context.with_profile_json(_profiles(spark, sf))
    return profile.select(
        "customer_unique_id",
        F.get_json_object("perfil_json", "$.segmento_crm").alias("segmento_crm"),
        F.get_json_object("perfil_json", "$.historial_compras").alias("historial_compras"),
        F.get_json_object("perfil_json", "$.experiencia_negativa_previa.categoria").alias("queja"),
        F.md5(F.get_json_object("perfil_json", "$.experiencia_negativa_previa.detalle_original")).alias("detalle_md5"),
        F.col("perfil_json").contains("experiencia_negativa_previa").alias("has_complaint"),
    )


@query
def render_context(spark: SparkSession, sf: str) -> DataFrame:
    prompts = context.render_context(_profiles(spark, sf), materialize(_catalog_products(spark, sf), "catalog"))
    return prompts.select(
        "customer_unique_id", "persona", F.length("system_prompt").cast("long").alias("n_chars"), F.md5("system_prompt").alias("prompt_md5")
    )


@query
def catalog_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = catalog.catalog_filter(_catalog_products(spark, sf), tag="hogar", price_between=(1000.0, 1_000_000.0), featured=True)
    return kept.select("id", "categoria", "precio_promedio_real")


# --- joins ------------------------------------------------------------------------


@query
def join_sales_items(spark: SparkSession, sf: str) -> DataFrame:
    return sales.sales_items(
        proxies.orders_p(spark, sf), proxies.items_p(spark, sf), proxies.products_p(spark, sf), proxies.translation_p(spark, sf)
    )


@query
def join_reviews_items(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.review_items(
        proxies.review_scores_p(spark, sf), proxies.items_p(spark, sf), proxies.products_p(spark, sf), proxies.translation_p(spark, sf)
    )


@query
def join_order_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return _order_rows(spark, sf).select("order_id", "customer_unique_id", rnd("ingresos", 2))


@query
def join_rate(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.join_rate(_pain_counts(spark, sf)).select("categoria", "total_resenas", "resenas_negativas")


@query
def join_pain_rate(spark: SparkSession, sf: str) -> DataFrame:
    counts = materialize(_pain_counts(spark, sf), "pain-counts")
    return reviews.join_pain_rate(counts, MIN_REVIEWS).select("categoria", "pain", "total_resenas", "resenas_negativas_pain", rnd("tasa"))


@query
def join_geo(spark: SparkSession, sf: str) -> DataFrame:
    joined = geo.join_geo(_order_rows(spark, sf), geo.zip_centroid(proxies.geolocation_p(spark, sf)))
    return joined.select("order_id", "customer_zip_code_prefix", rnd("ingresos", 2), rnd("lat", 9), rnd("lng", 9))


@query
def anti_done(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _corpus(spark, sf)
    return complaints.anti_done(corpus, corpus.filter(F.col("review_score") == 1)).select("review_id", "review_score")


@query
def exclude_purchased(spark: SparkSession, sf: str) -> DataFrame:
    """Pool of the customer's segment without what the customer bought."""
    bought = _purchases(spark, sf)
    segments = _segments(spark, sf)
    pool = materialize(recommend.candidate_pool(bought, segments, size=50), "pool")
    left = recommend.segment_candidates(segments, pool, bought)
    return left.groupBy("customer", "segmento").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum("rank").alias("rank_sum"))


@query
def customer_complaint(spark: SparkSession, sf: str) -> DataFrame:
    return _latest_complaints(spark, sf).select("customer_unique_id", "review_id", "queja_categoria", F.md5("queja_detalle").alias("detalle_md5"))


@query
def feedback_join(spark: SparkSession, sf: str) -> DataFrame:
    events = proxies.events_p(spark, sf)
    joined = feedback.feedback_join(_served(events), _actions(events))
    return joined.select("served_id", "customer_id", "product_id", "action", rnd("delay_seconds"))


# --- aggregations -----------------------------------------------------------------


@query
def order_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return sales.order_revenue(proxies.items_p(spark, sf)).select("order_id", rnd("revenue", 2))


@query
def reviews_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.reviews_by_category(_pain_counts(spark, sf))


@query
def bad_reviews_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.bad_reviews_by_category(_pain_counts(spark, sf))


@query
def dissatisfaction_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = reviews.dissatisfaction_rate(_pain_counts(spark, sf), MIN_REVIEWS)
    return rates.select("categoria", "total_resenas", "resenas_negativas", rnd("tasa_insatisfaccion"))


@query
def pain_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.pain_distribution(_classified(spark, sf)).select("pain_point_category", "quejas", rnd("pct"))


@query
def combined_share(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.combined_share(_classified(spark, sf)).select("n_quejas", rnd("pct_1"), rnd("pct_2"), rnd("pct_combined"))


@query
def eligible_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.eligible_counts(_pain_counts(spark, sf), MIN_REVIEWS)


@query
def _rfm_table(spark: SparkSession, sf: str) -> DataFrame:
    return _rfm(spark, sf).select("customer_unique_id", "recency", "frequency", rnd("monetary", 2))


QUERIES["rfm"] = QUERIES.pop("rfm_table")


@query
def frequency_split(spark: SparkSession, sf: str) -> DataFrame:
    return rfm.frequency_split(_rfm(spark, sf)).select("grupo", "clientes", rnd("pct"))


@query
def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = cluster.cluster_stats(cluster.kmeans_assign(_scaled(spark, sf), SCALED, CENTROIDS))
    return stats.select("cluster", rnd("recency"), rnd("frequency"), rnd("monetary", 4), "n")


@query
def segment_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = cluster.segment_summary(_labelled(spark, sf))
    return summary.select("segmento", "clientes", rnd("recency_med"), rnd("freq_media"), rnd("monetary_med", 4), rnd("pct"), "sin_segmento")


@query
def city_stats(spark: SparkSession, sf: str) -> DataFrame:
    return geo.city_stats(_accounts(spark, sf)).withColumn("ingresos_totales", F.round("ingresos_totales", 2))


@query
def city_geo(spark: SparkSession, sf: str) -> DataFrame:
    cities = geo.city_geo(_all_points(spark, sf))
    return cities.select("customer_city", "customer_state", rnd("ingresos", 2), "ordenes", rnd("lat", 9), rnd("lng", 9))


@query
def zip_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return geo.zip_centroid(proxies.geolocation_p(spark, sf)).select("zip", rnd("lat", 9), rnd("lng", 9))


@query
def weighted_centroid(spark: SparkSession, sf: str) -> DataFrame:
    center = geo.weighted_centroid(_city_points(spark, sf))
    return center.select(rnd("lat_opt", 9), rnd("lng_opt", 9), rnd("lat_simple", 9), rnd("lng_simple", 9), "n_orders", rnd("ingresos", 2))


@query
def coverage_stats(spark: SparkSession, sf: str) -> DataFrame:
    points = _city_points(spark, sf)
    return geo.coverage_stats(points, geo.weighted_centroid(points)).select("n_orders", rnd("km_mean"), rnd("km_median"), rnd("km_p80"))


@query
def centroid_shift(spark: SparkSession, sf: str) -> DataFrame:
    return geo.centroid_shift(geo.weighted_centroid(_city_points(spark, sf))).select(rnd("shift_km"))


@query
def match_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return geo.match_coverage(_zip_totals(spark, sf), geo.zip_centroid(proxies.geolocation_p(spark, sf)))


@query
def price_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = catalog.price_stats(_category_sales(spark, sf))
    return stats.select("categoria", rnd("precio_promedio", 4), "minimo", "maximo", "unidades_vendidas")


@query
def ticket_gap(spark: SparkSession, sf: str) -> DataFrame:
    return sales.ticket_gap(_category_sales(spark, sf)).select("categoria", rnd("avg_price", 4), "rank_units", "rank_revenue", "rank_gain")


def _ngram_counts(spark: SparkSession, sf: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    tokens = proxies.reviews_p(spark, sf).select(text.clean_tokens(F.col("review_comment_message")).alias("tokens"))
    return ngrams.ngram_counts(tokens, sizes=sizes)


@query
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _ngram_counts(spark, sf)


@query
def vocab_limit(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.vocab_limit(materialize(_ngram_counts(spark, sf), "ngrams"))


@query
def corpus_term_weights(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.corpus_term_weights(_ngram_counts(spark, sf, (1,))).withColumn("weight", F.round("weight", 6))


@query
def popularity(spark: SparkSession, sf: str) -> DataFrame:
    """Top 10 products overall, per category and per segment."""
    bought = _purchases(spark, sf)
    named = sales.product_categories(proxies.products_p(spark, sf), proxies.translation_p(spark, sf)).withColumnRenamed("product_id", "product")
    overall = recommend.product_popularity(bought)
    segments = recommend.product_popularity(bought.join(_segments(spark, sf), "customer"), ["segmento"])
    columns = ["scope", "part", "product", "units", "rank"]
    parts = [
        recommend.top_products(overall, 10).select(F.lit("global").alias("scope"), F.lit("all").alias("part"), *columns[2:]),
        recommend.top_products(overall.join(named, "product"), 10, ["categoria"]).select(
            F.lit("categoria").alias("scope"), F.col("categoria").alias("part"), *columns[2:]
        ),
        recommend.top_products(segments, 10, ["segmento"]).select(F.lit("segmento").alias("scope"), F.col("segmento").alias("part"), *columns[2:]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def feedback_metrics(spark: SparkSession, sf: str) -> DataFrame:
    events = proxies.events_p(spark, sf)
    joined = feedback.feedback_join(_served(events), _actions(events), 7 * 86_400)
    metrics = feedback.feedback_metrics(joined, proxies.products_p(spark, sf))
    return metrics.select("n_served", rnd("ctr_pct"), rnd("conversion_pct"), "n_products", rnd("coverage_pct"))


# --- rankings and samples ---------------------------------------------------------


@query
def top_k_volume(spark: SparkSession, sf: str) -> DataFrame:
    return questions.best_sellers(proxies.marketplace(spark, sf))[0]


@query
def top_k_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return questions.best_sellers(proxies.marketplace(spark, sf))[1].withColumn("ingreso_total", F.round("ingreso_total", 2))


@query
def top_cities(spark: SparkSession, sf: str) -> DataFrame:
    """Top 10 by revenue and top 10 by orders."""
    stats = materialize(geo.city_stats(_accounts(spark, sf)), "city-stats")
    parts = [
        geo.top_cities(stats, by).select(F.lit(by).alias("criterio"), "customer_city", "customer_state", "ordenes", rnd("ingresos_totales", 2))
        for by in ("ingresos_totales", "ordenes")
    ]
    return parts[0].unionByName(parts[1])


@query
def best_city(spark: SparkSession, sf: str) -> DataFrame:
    return geo.best_city(geo.city_stats(_accounts(spark, sf))).withColumn("ingresos_totales", F.round("ingresos_totales", 2))


@query
def top_k_per_pain(spark: SparkSession, sf: str) -> DataFrame:
    counts = materialize(_pain_counts(spark, sf), "pain-counts")
    return reviews.top_k_per_pain(counts, MIN_REVIEWS).select("pain", "posicion", "categoria", "total_resenas", "resenas_negativas_pain", rnd("tasa"))


@query
def pain_multi_top(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.pain_multi_top(materialize(_pain_counts(spark, sf), "pain-counts"), MIN_REVIEWS, at_least=2)


@query
def top_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.top_ngrams(_ngram_counts(spark, sf))


@query
def arg_extreme(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.arg_extreme(cluster.cluster_stats(cluster.kmeans_assign(_scaled(spark, sf), SCALED, CENTROIDS_3)), "recency")


def _silhouettes(spark: SparkSession, sf: str) -> DataFrame:
    scaled = materialize(_scaled(spark, sf), "scaled")
    labels = {len(c): (cluster.nearest(SCALED, c)["cluster"], range(len(c))) for c in (CENTROIDS, CENTROIDS_3)}
    found = cluster.euclidean_silhouettes(scaled, SCALED, labels)
    return spark.createDataFrame([(k, float(s), n) for k, (s, n) in found.items()], "k long, silhouette double, n long").withColumn("silhouette", F.round("silhouette", 6))


@query
def argmax_k(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.argmax_k(_silhouettes(spark, sf))


@query
def segment_exemplar(spark: SparkSession, sf: str) -> DataFrame:
    return context.segment_exemplar(_labelled(spark, sf)).withColumn("monetary", F.round("monetary", 2))


@query
def sample_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.sample_fixed(proxies.orders_p(spark, sf).select("order_id", "order_status"), "order_id", 3000)


@query
def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.candidate_pool(_purchases(spark, sf), _segments(spark, sf), _ratings(spark, sf))


# --- set operations and reshaping ---------------------------------------------------


@query
def union_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).withColumn("monetary", F.round("monetary", 2))


@query
def union_results(spark: SparkSession, sf: str) -> DataFrame:
    classified = _classified(spark, sf).select("review_id", "pain_point_category")
    old = classified.filter(F.col("review_id") % 2 == 0)
    new = classified.filter(F.col("review_id") % 2 == 1).withColumn("run", F.lit(2))
    return complaints.union_results(new, old)


@query
def zip_points(spark: SparkSession, sf: str) -> DataFrame:
    """(lat, lng, weight) of every located order of the best city."""
    totals = _zip_totals(spark, sf)
    rows = geo.in_city(_order_rows(spark, sf), _best_city(totals))
    points = geo.join_geo(rows, geo.zip_centroid(proxies.geolocation_p(spark, sf)))
    return points.select(rnd("lat", 9), rnd("lng", 9), F.round("ingresos", 2).alias("weight"))


@query
def heat_grid(spark: SparkSession, sf: str) -> DataFrame:
    return geo.heat_grid(_all_points(spark, sf)).withColumn("ingresos", F.round("ingresos", 2))


@query
def catalog_doc(spark: SparkSession, sf: str) -> DataFrame:
    document = catalog.catalog_doc(_catalog_products(spark, sf))
    return document.select("version", "total_productos", F.posexplode("productos").alias("pos", "p")).select(
        "version", "total_productos", F.col("pos").cast("long").alias("pos"), "p.id", "p.precio_promedio_real", "p.unidades_vendidas",
        F.array_join("p.tags", "|").alias("tags"),
    )


# --- machine learning ------------------------------------------------------------------


@query
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf, None).select("customer_unique_id", rnd("recency_s"), rnd("monetary_s"))


@query
def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and centres of the best of several fits to the recurrent customers."""
    scaled = materialize(_scaled(spark, sf), "scaled")
    centroids, _ = cluster.kmeans_fit(scaled, SCALED, "customer_unique_id", 3)
    return cluster.kmeans_step(scaled, SCALED, centroids).select("cluster", "n", rnd("recency_s"), rnd("monetary_s"))


@query
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.kmeans_assign(_scaled(spark, sf), SCALED, CENTROIDS_3).select("customer_unique_id", "cluster", rnd("dist2"))


@query
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.kmeans_step(_scaled(spark, sf), SCALED, CENTROIDS_3).select("cluster", "n", rnd("recency_s"), rnd("monetary_s"))


@query
def inertia(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.inertia(_scaled(spark, sf), SCALED, CENTROIDS_3).select(rnd("inertia", 4), "n")


@query
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return _silhouettes(spark, sf)


@query
def k_search(spark: SparkSession, sf: str) -> DataFrame:
    """Silhouette of every k for the recurrent customers, with real fits."""
    scaled = materialize(_scaled(spark, sf), "scaled")
    found = cluster.k_search(scaled, SCALED, "customer_unique_id", cluster.RECURRENT_KS)
    return spark.createDataFrame([(k, round(float(score), 6)) for k, score, _ in found], "k long, silhouette double")


@query
def segment_customers(spark: SparkSession, sf: str) -> DataFrame:
    return questions.customer_segments(proxies.marketplace(spark, sf)).withColumn("monetary", F.round("monetary", 2))


@query
def segment_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Orders come in three batches, the last of two years; its customers are merged and assigned by the saved model."""
    base, orders = fresh_path(spark, "rfm-state"), proxies.orders_p(spark, sf)
    items, customers = proxies.items_p(spark, sf), proxies.customers_p(spark, sf)
    end = sales.filter_delivered(orders).select(scalars.reference_date(F.max("order_purchase_timestamp"))).scalar()
    age = scalars.recency_days(end, F.col("order_purchase_timestamp"))
    for batch, (youngest, oldest) in enumerate([(1461, 10**6), (731, 1460), (-1, 730)], 1):
        rfm_state.add_orders(base, batch, orders.filter(age.between(youngest, oldest)), items, customers)
        if batch == 2:
            rfm_state.fold(spark, base)
    reference, recurrent = rfm_state.latest_reference(spark, base), F.col("frequency") >= 2
    path = fresh_path(spark, "model")
    cluster.save_model(materialize(rfm_state.as_rfm(rfm_state.customer_sums(spark, base), reference).filter(recurrent), "rfm"), ["recency", "monetary"], CENTROIDS, path)
    recent = rfm_state.as_rfm(rfm_state.changed_sums(spark, base, 3), reference).filter(recurrent)
    return cluster.assign_saved(recent, ["recency", "monetary"], path).select("customer_unique_id", "cluster")


@query
def item_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of products with the customers who bought both."""
    return recommend.item_cooccurrence(_purchases(spark, sf))


@query
def item_cf_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of products with the likeness of their buyer sets."""
    bought = _purchases(spark, sf)
    near = recommend.item_similarity(recommend.item_cooccurrence(bought), bought)
    return near.select("product_a", "product_b", rnd("similarity"))


@query
def item_cf_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Collaborative filtering over the segment's pool, with views and clicks as a small addition."""
    bought, segments = _purchases(spark, sf), _segments(spark, sf)
    pool = materialize(recommend.candidate_pool(bought, segments), "pool")
    implicit = recommend.implicit_weights(proxies.events_p(spark, sf), WEIGHTS)
    return recommend.item_cf_rank(bought, segments, pool, 10, implicit, IMPLICIT_SHARE).select("customer", "product", "score", "rank")


@query
def content_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.content_similarity(_features(spark, sf)).select("product", "neighbour", rnd("price_gap", 4), "rank")


@query
def recommend_route(spark: SparkSession, sf: str) -> DataFrame:
    everyone = proxies.customers_p(spark, sf).select(F.col("customer_unique_id").alias("customer"))
    return recommend.recommend_route(everyone, _purchases(spark, sf))


@query
def recommend_all(spark: SparkSession, sf: str) -> DataFrame:
    implicit = recommend.implicit_weights(proxies.events_p(spark, sf), WEIGHTS)
    return questions.recommendations(
        proxies.marketplace(spark, sf), _features(spark, sf), _segments(spark, sf), implicit=implicit, implicit_share=IMPLICIT_SHARE
    )


@query
def implicit_weights(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.implicit_weights(proxies.events_p(spark, sf), WEIGHTS).withColumn("score", F.round("score", 4))


@query
def publish_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Two published versions; the reader sees the second one."""
    base = fresh_path(spark, "pools")
    bought = _purchases(spark, sf)
    segments = _segments(spark, sf)
    documents.publish(recommend.candidate_pool(bought, segments, size=50), base)
    documents.publish(recommend.candidate_pool(bought, segments, size=100), base)
    return documents.read_published(spark, base)


# --- user functions -----------------------------------------------------------------


@query
def classify_complaints(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("review_id", "order_id", "review_score", "pain_point_category")


@query
def classify_plugged(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's model in Arrow batches: here it answers from the prompt length."""
    names = TAXONOMY

    def answer(prompts):
        return prompts.str.len().mod(len(names)).map(lambda i: f"The answer: {names[i].lower()}.")

    return complaints.classify_with(_corpus(spark, sf), answer).select("review_id", "pain_point_category")


@query
def apply_clean(spark: SparkSession, sf: str) -> DataFrame:
    """One function over all text columns of a table."""
    parts = proxies.read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    cleaned = profiling.apply_columns(parts, ["p_name", "p_brand", "p_type"], text.clean_text, "_limpio")
    return cleaned.select("p_partkey", "p_name_limpio", "p_brand_limpio", "p_type_limpio")


@query
def agg_lambda(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates per customer from functions of a column: days since the last order, days between orders, range of order values."""
    orders = materialize(_order_rows(spark, sf), "order-rows")
    end = orders.select(scalars.reference_date(F.max("order_purchase_timestamp"))).scalar()
    return profiling.aggregate_by(
        orders.filter(F.col("customer_unique_id").isNotNull()),
        ["customer_unique_id"],
        {
            "recency": ("order_purchase_timestamp", lambda t: scalars.recency_days(end, F.max(t))),
            "span_days": ("order_purchase_timestamp", lambda t: scalars.recency_days(F.max(t), F.min(t))),
            "ticket_range": ("ingresos", lambda x: F.round(F.max(x) - F.min(x), 2)),
        },
    )


# --- streaming -------------------------------------------------------------------------


@query
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of closed and open windows alike."""
    keys = ["window_start", "customer_id", "event_type"]
    counts = stream.run_update(stream.event_counts(stream.read_events(spark, sf)), keys, *stream.scratch(spark, "event-counts"))
    return counts.select(stamp(F.col("window_start")).alias("window_start"), "customer_id", "event_type", "n")


@query
def stream_implicit_scores(spark: SparkSession, sf: str) -> DataFrame:
    target, checkpoint = stream.scratch(spark, "implicit")
    scores = stream.implicit_scores(stream.read_events(spark, sf), WEIGHTS)
    return stream.run_update(scores, ["customer_id", "product_id"], target, checkpoint).withColumn("score", F.round("score", 4))


def _to_the_end(spark: SparkSession, sf: str, stateful: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Two runs of one stream: over the events, then, from its checkpoint, over a heartbeat a month after the last of them."""
    target, checkpoint = stream.scratch(spark, label)
    pulse = fresh_path(spark, f"{label}-pulse")
    stream.beat(spark, pulse)

    def run() -> DataFrame:
        return stream.run_append(stateful(stream.with_heartbeats(stream.read_events(spark, sf), pulse)), target, checkpoint)

    run()
    stream.beat(spark, pulse, proxies.events_p(spark, sf).select((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")))
    return run()


@query
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Every visit once, when it is over; the heartbeat ends the last ones."""
    visits = _to_the_end(spark, sf, stream.sessions, "sessions")
    return visits.select("customer_id", stamp(F.col("session_start")).alias("session_start"), "n_events", rnd("dwell_seconds"))


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event delivered twice, kept once."""
    twice = stream.read_events(spark, sf).unionByName(stream.read_events(spark, sf))
    kept = stream.run_append(stream.deduplicate(twice), *stream.scratch(spark, "dedup"))
    return kept.select("event_id", "customer_id", "event_type", "product_id")


def _streamed_feedback(spark: SparkSession, sf: str) -> DataFrame:
    def answers(events: DataFrame) -> DataFrame:
        served = events.filter(F.col("event_type").isin("view", stream.HEARTBEAT))
        return stream.first_actions(served, events.filter(F.col("event_type").isin("click", "purchase")))

    return _to_the_end(spark, sf, answers, "feedback")


@query
def stream_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Every served row with the first action on it, none where there was none."""
    return _streamed_feedback(spark, sf).select("served_id", "action")


@query
def stream_feedback_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """CTR, conversion and coverage of what the streams wrote."""
    metrics = feedback.feedback_metrics(_streamed_feedback(spark, sf), proxies.products_p(spark, sf))
    return metrics.select("n_served", rnd("ctr_pct"), rnd("conversion_pct"), "n_products", rnd("coverage_pct"))


@query
def stream_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Review files classified as a stream; the second run adds nothing."""
    landing = fresh_path(spark, "reviews")
    arriving = proxies.reviews_p(spark, sf)
    arriving.write.parquet(landing)
    target, checkpoint = stream.scratch(spark, "stream-classified")

    def classifier(rows: DataFrame) -> DataFrame:
        return complaints.classify_by_signals(rows, proxies.PROXY_SIGNALS)

    for _ in range(2):
        source = stream_complaints.read_reviews(spark, landing, arriving.schema)
        done = stream_complaints.classify_stream(source, target, checkpoint, classifier)
    return done.select("review_id", "order_id", "review_score", "pain_point_category")
