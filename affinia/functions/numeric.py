"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def rounded(x: Column | str, places: int = 6) -> Column:
    """Half away from zero, never -0.0, so that engines agree."""
    return (F.round(F.col(x) if isinstance(x, str) else x, places) + F.lit(0.0)).cast("double")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance of two points given in degrees."""
    la1, la2 = F.radians(lat1), F.radians(lat2)
    inner = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(inner))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def format_p(p: Column, draws: int) -> Column:
    """A permutation p-value with its floor of 1 / (draws + 1)."""
    floor = 1.0 / (draws + 1)
    return F.when(p <= floor, F.format_string("< %.5f", F.lit(floor))).otherwise(F.format_string("%.4f", p))
