"""Geometry as column expressions: great circles, projections, slippy tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three Earth radii are in use, each for results of its own.
RADIUS_KM, RADIUS_M, RADIUS_PLACE_M = 6371.0, 6_371_000.0, 6_371_008.8


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS_KM) -> Column:
    """Great-circle distance in the unit of the radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def project_param(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column, p_lat: Column, p_lng: Column, clamp_low: bool | Column = True, clamp_high: bool = True) -> Column:
    """Where the foot of p lies on a-b (0 at a, 1 at b), longitudes scaled by the cosine of the middle latitude."""
    scale = F.cos(F.radians((a_lat + b_lat) / 2))
    dx, dy = (b_lng - a_lng) * scale, b_lat - a_lat
    size = dx * dx + dy * dy
    t = ((p_lng - a_lng) * scale * dx + (p_lat - a_lat) * dy) / F.nullif(size, F.lit(0.0))
    if isinstance(clamp_low, Column):
        t = F.when(clamp_low, F.greatest(F.lit(0.0), t)).otherwise(t)
    elif clamp_low:
        t = F.greatest(F.lit(0.0), t)
    if clamp_high:
        t = F.least(F.lit(1.0), t)
    return F.when(size == 0, 0.0).otherwise(t)


def segment_distance_plain(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column, p_lat: Column, p_lng: Column) -> Column:
    """Metres from p to the segment a-b; the foot is found in unscaled degrees."""
    dx, dy = b_lng - a_lng, b_lat - a_lat
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p_lng - a_lng) * dx + (p_lat - a_lat) * dy) / F.nullif(size, F.lit(0.0))))
    t = F.when(size == 0, 0.0).otherwise(t)
    return haversine(p_lat, p_lng, a_lat + t * dy, a_lng + t * dx, RADIUS_M)


def tile_x(lng: Column, zoom: int) -> Column:
    n = 2**zoom
    return F.least(F.greatest(((lng + 180.0) / 360.0 * n).cast("int"), F.lit(0)), F.lit(n - 1))


def tile_y(lat: Column, zoom: int) -> Column:
    n = 2**zoom
    r = F.radians(lat)
    return F.least(F.greatest(((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n).cast("int"), F.lit(0)), F.lit(n - 1))


def tile_west(x: Column, zoom: int) -> Column:
    return x / F.lit(float(2**zoom)) * 360.0 - 180.0


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / F.lit(float(2**zoom))))))


METRES_PER_DEGREE = 111_320.0


def buffer_lng(metres: float, middle_lat: Column) -> Column:
    """Degrees of longitude for a distance at a latitude."""
    return F.lit(metres) / (F.lit(METRES_PER_DEGREE) * F.greatest(F.lit(0.1), F.cos(F.radians(middle_lat))))


def edge_seconds(km: Column, speed_a: Column, speed_b: Column) -> Column:
    """Travel time at the mean of both ends' speeds."""
    return km / F.greatest((speed_a + speed_b) / 2.0, F.lit(1.0)) * 3600.0


def tier_speed(tier: Column) -> Column:
    return F.when(tier == 1, 35.0).when(tier == 2, 25.0).otherwise(28.0)
