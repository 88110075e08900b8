"""Greatest common divisor, great-circle distance and routing scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
_EUCLID_STEPS = 92  # enough for any two 64-bit numbers


def gcd(a: Column, b: Column) -> Column:
    """GCD of two integers; a null counts as 0, as in the GCD of a set without that member."""
    pair = F.struct(F.abs(F.coalesce(a, F.lit(0))).cast("long").alias("x"), F.abs(F.coalesce(b, F.lit(0))).cast("long").alias("y"))
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.try_mod(p["x"], p["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_EUCLID_STEPS)), pair, step, lambda p: p["x"])


def gcd_agg(c: Column | str) -> Column:
    """GCD of a group's distinct non-null integers: null for a group without any.

    Distinct values are collected, so the state of a group is bounded by the
    number of different values and not by its rows.
    """
    values = F.collect_set(F.col(c) if isinstance(c, str) else c)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: gcd(acc, x)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres of points in degrees; null if a coordinate is null."""
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def replica_score(distance_km: Column, load: Column, is_leader: Column) -> Column:
    """Lower is better: distance, plus 100 per unit of load, less 50 for a leader."""
    return distance_km + 100 * load - F.when(is_leader, 50).otherwise(0)
