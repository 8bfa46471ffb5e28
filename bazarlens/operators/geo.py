"""Best city, revenue-weighted centre and coverage.

Orders are combined per customer account first, then per (city, state, zip).
All results are sums over orders, and percentiles take the number of orders as
frequency, so they equal those over single orders, while an account or a zip
that holds a third of all orders is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlens.functions.quantiles import exact_percentiles
from bazarlens.functions.scalars import circle_radius, geo_valid, planar_km
from bazarlens.operators.profiling import top_k
from bazarlens.session import materialize


def city_stats(accounts: DataFrame) -> DataFrame:
    """Orders, revenue and distinct persons per city and state."""
    return (
        accounts.filter(F.col("customer_city").isNotNull() & F.col("customer_state").isNotNull())
        .groupBy("customer_city", "customer_state")
        .agg(
            F.sum("n_orders").alias("ordenes"),
            F.sum("ingresos").alias("ingresos_totales"),
            F.countDistinct("customer_unique_id").alias("clientes_unicos"),
        )
    )


def top_cities(stats: DataFrame, by: str = "ingresos_totales", k: int = 10) -> DataFrame:
    return top_k(stats, [F.desc(by), F.asc("customer_city"), F.asc("customer_state")], k)


def best_city(stats: DataFrame) -> DataFrame:
    """The city with the largest revenue, as one row."""
    return top_cities(stats, k=1)


def zip_centroid(geolocation: DataFrame) -> DataFrame:
    """Mean coordinates of each zip prefix."""
    return (
        geolocation.filter(F.col("geolocation_zip_code_prefix").isNotNull())
        .groupBy(F.col("geolocation_zip_code_prefix").alias("zip"))
        .agg(F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng"))
    )


def join_geo(order_rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Order rows with the coordinates of their zip, invalid ones dropped."""
    joined = order_rows.join(centroids, order_rows["customer_zip_code_prefix"] == centroids["zip"]).drop("zip")
    return joined.filter(geo_valid(F.col("lat"), F.col("lng")))


def zip_totals(accounts: DataFrame) -> DataFrame:
    """(city, state, zip, n_orders, revenue): the grain of the analysis."""
    return accounts.groupBy("customer_city", "customer_state", F.col("customer_zip_code_prefix").alias("zip")).agg(
        F.sum("n_orders").alias("n_orders"), F.sum("ingresos").alias("ingresos")
    )


def located(totals: DataFrame, centroids: DataFrame) -> DataFrame:
    """Zip totals with valid coordinates."""
    return totals.join(centroids, "zip").filter(geo_valid(F.col("lat"), F.col("lng")))


def in_city(totals: DataFrame, city: Column, state: Column | None = None) -> DataFrame:
    """Rows of one city; by name only unless a state is given."""
    chosen = totals.filter(F.col("customer_city") == city)
    return chosen if state is None else chosen.filter(F.col("customer_state") == state)


def match_coverage(totals: DataFrame, centroids: DataFrame) -> DataFrame:
    """Orders before the geo join, with coordinates, with valid coordinates."""
    joined = totals.join(centroids, "zip", "left")
    matched = F.col("lat").isNotNull() & F.col("lng").isNotNull()

    def orders(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n_orders"))), F.lit(0))

    return joined.agg(
        orders(F.lit(True)).alias("n_orders"),
        orders(matched).alias("n_matched"),
        orders(matched & geo_valid(F.col("lat"), F.col("lng"))).alias("n_valid"),
    )


def weighted_centroid(points: DataFrame) -> DataFrame:
    """Revenue-weighted and plain centre; null where the weights are zero."""
    n, w = F.sum("n_orders"), F.sum("ingresos")

    def mean(coordinate: str, weight: str, total: Column) -> Column:
        return F.try_divide(F.sum(F.col(coordinate) * F.col(weight)), F.nullif(total.cast("double"), F.lit(0.0)))

    return points.agg(
        mean("lat", "ingresos", w).alias("lat_opt"),
        mean("lng", "ingresos", w).alias("lng_opt"),
        mean("lat", "n_orders", n).alias("lat_simple"),
        mean("lng", "n_orders", n).alias("lng_simple"),
        n.alias("n_orders"),
        w.alias("ingresos"),
    )


def centroid_shift(centroid: DataFrame) -> DataFrame:
    """Distance between the weighted and the plain centre, in km."""
    km = planar_km(F.col("lat_simple"), F.col("lng_simple"), F.col("lat_opt"), F.col("lng_opt"))
    return centroid.select("lat_opt", "lng_opt", "lat_simple", "lng_simple", km.alias("shift_km"))


def with_distance(points: DataFrame, centroid: DataFrame) -> DataFrame:
    """Adds the distance to the weighted centre, which enters as a scalar subquery."""
    center = centroid.select(F.struct("lat_opt", "lng_opt")).scalar()
    return points.withColumn("km", planar_km(F.col("lat"), F.col("lng"), center["lat_opt"], center["lng_opt"]))


def coverage_stats(points: DataFrame, centroid: DataFrame) -> DataFrame:
    """Mean, median and 80 % radius of the distance of orders to the centre.

    One row per zip goes in, written once; its orders are its weight in the
    percentiles, which take a fixed number of passes and no buffer of values.
    """
    n = F.col("n_orders")
    placed = materialize(with_distance(points, centroid).select("km", "n_orders"), "distances")
    ranks = exact_percentiles(placed, ["km"], [0.5, 0.8], weight="n_orders").select(F.struct("*")).scalar()
    totals = placed.agg(
        F.sum("n_orders").alias("n_orders"),
        F.try_divide(F.sum(F.col("km") * n), F.sum(n).cast("double")).alias("km_mean"),
    )
    return totals.select("n_orders", "km_mean", ranks["km_p50"].alias("km_median"), ranks["km_p80"].alias("km_p80"))


def city_geo(points: DataFrame) -> DataFrame:
    """Revenue, orders and mean coordinates per city and state."""
    n = F.col("n_orders")
    return (
        points.filter(F.col("customer_city").isNotNull() & F.col("customer_state").isNotNull())
        .groupBy("customer_city", "customer_state")
        .agg(
            F.sum("ingresos").alias("ingresos"),
            F.sum("n_orders").alias("ordenes"),
            F.try_divide(F.sum(F.col("lat") * n), F.sum(n).cast("double")).alias("lat"),
            F.try_divide(F.sum(F.col("lng") * n), F.sum(n).cast("double")).alias("lng"),
        )
    )


def circles(cities: DataFrame, chosen_city: Column, k: int = 20) -> DataFrame:
    """Radius and highlight flag of the k cities with the largest revenue."""
    largest = cities.select(F.max("ingresos")).scalar()
    top = top_k(cities, [F.desc("ingresos"), F.asc("customer_city"), F.asc("customer_state")], k)
    return top.select(
        "customer_city",
        "customer_state",
        "ingresos",
        circle_radius(F.col("ingresos"), largest).alias("radio_m"),
        (F.col("customer_city") == chosen_city).alias("es_top"),
    )


def heat_grid(points: DataFrame, step: float = 0.05) -> DataFrame:
    """Revenue and orders per cell of a regular grid of ``step`` degrees."""
    return points.groupBy(
        F.floor(F.col("lat") / F.lit(step)).alias("cell_lat"), F.floor(F.col("lng") / F.lit(step)).alias("cell_lng")
    ).agg(F.sum("ingresos").alias("ingresos"), F.sum("n_orders").alias("ordenes"))
