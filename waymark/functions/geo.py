"""Distances on the flattened earth and geohash cells, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Equatorial and polar radius in metres, and the result for two equal points.
EQUATOR_M = 6378140
POLE_M = 6356755
SAME_POINT_M = 1e-7

# Fixed value: geohash digits.
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"

GEOHASH_PRECISIONS = (4, 5, 6, 7, 8, 9)


def degrees(e5: Column | str) -> Column:
    """Degrees from integer 1e-5 degrees."""
    return (F.col(e5) if isinstance(e5, str) else e5) / F.lit(1e5)


def distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Metres between two points in degrees: spherical angle of the reduced latitudes plus flattening correction.

    The angle is taken from its half-angle sine, which equals the arc cosine form but keeps its digits on short hops.
    """
    ratio = F.lit(POLE_M / EQUATOR_M)
    flatten = F.lit((EQUATOR_M - POLE_M) / EQUATOR_M / 8)
    beta_a = F.atan(ratio * F.tan(F.radians(lat_a)))
    beta_b = F.atan(ratio * F.tan(F.radians(lat_b)))
    half_lat = F.sin((beta_b - beta_a) / 2)
    half_lon = F.sin((F.radians(lon_b) - F.radians(lon_a)) / 2)
    h = F.least(F.lit(1.0), half_lat * half_lat + F.cos(beta_a) * F.cos(beta_b) * half_lon * half_lon)
    x = F.asin(F.sqrt(h)) * 2
    sin_x = F.sqrt(h * (F.lit(1.0) - h)) * 2
    plus = F.sin(beta_a) + F.sin(beta_b)
    minus = F.sin(beta_a) - F.sin(beta_b)
    shrink = F.try_divide((sin_x - x) * (plus * plus), F.lit(1.0) - h)
    stretch = F.try_divide((sin_x + x) * (minus * minus), h)
    return F.when(h == 0, F.lit(SAME_POINT_M)).otherwise(F.lit(EQUATOR_M) * (x + flatten * (shrink - stretch)))


def metres(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """``distance_m`` in whole metres, half to even."""
    return F.rint(distance_m(lat_a, lon_a, lat_b, lon_b)).cast("bigint")


def metres_e5(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> Column:
    return metres(degrees(lat_a), degrees(lon_a), degrees(lat_b), degrees(lon_b))


def cell_x(lon_e5: Column, bits: int) -> Column:
    """Index of the longitude cell when the globe is cut into ``2**bits`` columns."""
    return F.least(F.expr(f"{2**bits - 1}L"), F.floor((lon_e5 + 18_000_000) * F.lit(2**bits) / 36_000_000))


def cell_y(lat_e5: Column, bits: int) -> Column:
    return F.least(F.expr(f"{2**bits - 1}L"), F.floor((lat_e5 + 9_000_000) * F.lit(2**bits) / 18_000_000))


def cell_bits(precision: int) -> tuple[int, int]:
    """(longitude bits, latitude bits) of a geohash of ``precision`` digits."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def _spread(value: Column) -> Column:
    """Move bit i of a 23-bit number to bit 2i."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def geohash_code(lat_e5: Column, lon_e5: Column) -> Column:
    """45-bit code of the 9-digit geohash; a cell of precision p is its ``5 * p`` leading bits."""
    return _spread(cell_x(lon_e5, 23)).bitwiseOR(F.shiftleft(_spread(cell_y(lat_e5, 22)), 1))


def coarser(code: Column, precision: int) -> Column:
    return F.shiftright(code, 5 * (9 - precision))


def geohash_text(code: Column, precision: int = 9) -> Column:
    """Digits of a ``precision``-digit cell from the 45-bit code."""
    digits = [
        F.substring(F.lit(GEOHASH_DIGITS), F.shiftright(code, 5 * (8 - i)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
        for i in range(precision)
    ]
    return F.concat(*digits)
