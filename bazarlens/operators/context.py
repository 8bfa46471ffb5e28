"""Customer context for a sales agent: history, status, persona, prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlens.functions.context import (
    catalog_block,
    history_text,
    order_status_text,
    profile_block,
    profile_json,
    prompt_text,
    scenario_route,
)


def with_history(
    segmented: DataFrame, medium_from: float = 100.0, high_from: float = 1000.0, recent_days: int = 30
) -> DataFrame:
    """Adds the history sentence and the order status sentence.

    The spend levels and the recency cutoff are not known from results; they
    are parameters and their defaults are ours.
    """
    return segmented.select(
        "*",
        history_text(F.col("frequency"), F.col("monetary"), F.col("recency"), medium_from, high_from).alias("historial_compras"),
        order_status_text(F.col("recency"), recent_days).alias("orden_status"),
    )


def customer_complaint(classified: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The latest classified complaint of every customer.

    The text is attached after the latest complaint was chosen by id, so the
    aggregation moves ids and dates only.
    """
    dated = (
        classified.select("review_id", "order_id", "pain_point_category")
        .join(orders.select("order_id", "customer_id", "order_purchase_timestamp"), "order_id")
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
    )
    latest = dated.groupBy("customer_unique_id").agg(
        F.max(F.struct("order_purchase_timestamp", "review_id", "pain_point_category")).alias("latest")
    )
    chosen = latest.select("customer_unique_id", "latest.review_id", F.col("latest.pain_point_category").alias("queja_categoria"))
    return chosen.join(
        classified.select("review_id", F.col("review_comment_message").alias("queja_detalle")), "review_id"
    )


def segment_exemplar(segmented: DataFrame) -> DataFrame:
    """The customer with the highest spend of each segment."""
    best = segmented.filter(F.col("segmento").isNotNull()).groupBy("segmento").agg(
        F.max_by(F.struct("customer_unique_id", "recency", "frequency", "monetary"), F.struct("monetary", "customer_unique_id")).alias("c")
    )
    return best.select("segmento", "c.*")


def customer_profiles(segmented: DataFrame, complaints: DataFrame, crm: DataFrame | None = None, **levels: float) -> DataFrame:
    """Everything known about each customer, with the persona that answers.

    ``crm`` may bring (customer_unique_id, edad, genero); without it the two
    fields are absent from the profile.
    """
    joined = with_history(segmented, **levels).join(complaints, "customer_unique_id", "left")
    if crm is None:
        joined = joined.withColumn("edad", F.lit(None).cast("int")).withColumn("genero", F.lit(None).cast("string"))
    else:
        joined = joined.join(crm.select("customer_unique_id", "edad", "genero"), "customer_unique_id", "left")
    return joined.withColumn("persona", scenario_route(F.col("segmento"), F.col("queja_categoria")))


def with_profile_json(profiles: DataFrame) -> DataFrame:
    """Adds the profile as compact JSON; unknown fields are left out."""
    return profiles.withColumn("perfil_json", profile_json())


def catalog_text(products: DataFrame) -> DataFrame:
    """The curated catalogue as one indented JSON text (one row)."""
    blocks = products.select("id", catalog_block().alias("block"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("id", "block"))), lambda p: p["block"])
    return blocks.agg(F.concat(F.lit("[\n"), F.array_join(ordered, ",\n"), F.lit("\n]")).alias("catalogo"))


def render_context(profiles: DataFrame, products: DataFrame) -> DataFrame:
    """The system prompt of every customer.

    The catalogue text is a single short value and enters as a scalar
    subquery; the persona texts are literals.
    """
    catalog = catalog_text(products).scalar()
    return profiles.select(
        "customer_unique_id",
        "persona",
        prompt_text(F.col("persona"), profile_block(), catalog, F.col("orden_status")).alias("system_prompt"),
    )
