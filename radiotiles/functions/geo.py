"""Geodesy as column expressions; angles are in radians unless a name says degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres of points in degrees."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def euclid3d_m(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def local_to_lat(y: Column, lat0: Column) -> Column:
    """Degrees of latitude of metres north of an origin in degrees."""
    return lat0 + y / METRES_PER_DEGREE


def local_to_lon(x: Column, lat0: Column, lon0: Column) -> Column:
    return lon0 + x / (METRES_PER_DEGREE * F.cos(F.radians(lat0)))


def span_lat(tile_m: Column | float) -> Column:
    return (F.lit(tile_m) if not isinstance(tile_m, Column) else tile_m) / EARTH_RADIUS_M


def span_lon(tile_m: Column | float, lat0: Column) -> Column:
    return (F.lit(tile_m) if not isinstance(tile_m, Column) else tile_m) / (EARTH_RADIUS_M * F.abs(F.cos(lat0)))


def utm_zone(lon_deg: Column) -> Column:
    return F.floor((lon_deg + 180.0) / 6.0).cast("int") + 1


def utm_epsg(lat_deg: Column, lon_deg: Column) -> Column:
    return F.when(lat_deg >= 0, 32600).otherwise(32700) + utm_zone(lon_deg)


# Transverse Mercator on WGS 84 by Krueger's series in the third flattening, to the fourth order.
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = 6_378_137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = (1 - (1 - _F) ** 2) ** 0.5
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
SCALE, FALSE_EASTING, FALSE_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def _central(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def utm(lat_deg: Column, lon_deg: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    sin, dl = F.sin(F.radians(lat_deg)), F.radians(lon_deg) - _central(zone)
    t = F.sinh(_atanh(sin) - _E * _atanh(_E * sin))
    xi, eta = F.atan2(t, F.cos(dl)), _atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * _A * x, F.when(south, FALSE_SOUTH).otherwise(0.0) + SCALE * _A * y


def utm_inverse(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    eta, xi = (east - FALSE_EASTING) / (SCALE * _A), (north - F.when(south, FALSE_SOUTH).otherwise(0.0)) / (SCALE * _A)
    e, x = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(_central(zone) + F.atan2(F.sinh(e), F.cos(x)))


def local_frame(lat_deg: Column, lon_deg: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, in the UTM zone of the origin."""
    zone, south = utm_zone(lon0), lat0 < 0
    e, n = utm(lat_deg, lon_deg, zone, south)
    e0, n0 = utm(lat0, lon0, zone, south)
    return e - e0, n - n0


def local_frame_inverse(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    zone, south = utm_zone(lon0), lat0 < 0
    e0, n0 = utm(lat0, lon0, zone, south)
    return utm_inverse(x + e0, y + n0, zone, south)
