"""WGS 84 longitude and latitude to UTM and back: the published transverse Mercator series, as column expressions.

Other coordinate systems are refused; a null SRID is pixel space and passes through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the UTM scale and offsets.
A, INV_F, K0, EAST, SOUTH = 6378137.0, 298.257223563, 0.9996, 500000.0, 10000000.0

_N = 1 / INV_F / (2 - 1 / INV_F)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the fourth order in the third flattening
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _zone(epsg: int) -> tuple[float, float]:
    """Central meridian in radians and false northing of a UTM code."""
    zone = epsg % 100
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is no UTM zone; only EPSG:4326 and UTM are supported")
    return (zone * 6 - 183) * 3.141592653589793 / 180, SOUTH if epsg // 100 == 327 else 0.0


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    middle, north = _zone(epsg)
    phi, lam = F.radians(lat), F.radians(lon) - middle
    c = 2 * _N**0.5 / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + K0 * _RADIUS * x, north + K0 * _RADIUS * y


def from_utm(east: Column, north: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    middle, shift = _zone(epsg)
    xi, eta = (north - shift) / (K0 * _RADIUS), (east - EAST) / (K0 * _RADIUS)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(y), F.cos(x)) + middle), F.degrees(phi)


def reproject(x: Column, y: Column, source: int | None, target: int | None) -> tuple[Column, Column]:
    """From one SRID to another. Equal, or no source: unchanged; a source without a target is an error."""
    if source == target or source is None:
        return x, y
    if target is None:
        raise ValueError("shapes have coordinates but the raster has none")
    lon, lat = (x, y) if source == 4326 else from_utm(x, y, source)
    return (lon, lat) if target == 4326 else to_utm(lon, lat, target)
