"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazarlens.fixed_values import (
    CIRCLE_BASE_M,
    CIRCLE_SPAN_M,
    KM_PER_DEGREE,
    LAT_BOUNDS,
    LNG_BOUNDS,
    UNKNOWN_CATEGORY,
)


def category_fallback(english: Column, portuguese: Column) -> Column:
    """English name, else the original name, else a fixed word."""
    return F.coalesce(english, portuguese, F.lit(UNKNOWN_CATEGORY))


def fill_zero_int(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)).cast("long")


def pct_rate(part: Column, whole: Column) -> Column:
    """Unrounded percentage; null where the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def round_half_even(value: Column, digits: int = 1) -> Column:
    """Rounding of the data-frame world: ties go to the even digit."""
    return F.bround(value, digits)


def reference_date(latest: Column) -> Column:
    """The day after the latest order: the 'today' of the analysis."""
    return latest + F.expr("INTERVAL 1 DAY")


def recency_days(reference: Column, latest: Column) -> Column:
    """Whole elapsed days (floor of elapsed time, not a calendar difference)."""
    return F.extract(F.lit("DAY"), reference - latest).cast("long")


def geo_valid(lat: Column, lng: Column) -> Column:
    return lat.between(*LAT_BOUNDS) & lng.between(*LNG_BOUNDS)


def planar_km(lat: Column, lng: Column, lat0: Column, lng0: Column) -> Column:
    """Distance on a plane tangent at the centre (lat0, lng0)."""
    dy = (lat - lat0) * F.lit(KM_PER_DEGREE)
    dx = (lng - lng0) * F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat0))
    return F.sqrt(dy * dy + dx * dx)


def circle_radius(revenue: Column, largest: Column) -> Column:
    return F.lit(CIRCLE_BASE_M) + F.try_divide(revenue, largest) * F.lit(CIRCLE_SPAN_M)


def title_case(text: Column) -> Column:
    return F.initcap(text)


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable random order that does not depend on partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
