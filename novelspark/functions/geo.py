"""Distances on the globe, dates, and Universal Transverse Mercator."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the mean radius of the Earth in km.
RADIUS_KM = 6371.0088


def known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Null if any coordinate is null or NaN."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    km = 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return F.when(known(lat1) & known(lon1) & known(lat2) & known(lon2), km)


def day_delta(before: Column, after: Column) -> Column:
    """Whole days from before to after; the first ten characters of either are its date. Null if either has none."""
    day = lambda c: F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")
    return F.date_diff(day(after), day(before))


def null_clean(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


# The WGS 84 ellipsoid and the scale of the projection's central meridian.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = 2 * math.sqrt(_N) / (1 + _N)


def utm_zone(crs: Column) -> Column:
    """The zone of EPSG:326zz or EPSG:327zz; null for any other system."""
    return F.when(crs.rlike(r"^EPSG:32[67](0[1-9]|[1-5][0-9]|60)$"), F.substring(crs, -2, 2).cast("int"))


def utm_forward(lat: Column, lon: Column, crs: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    zone = utm_zone(crs)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000.0 + F.lit(_K0 * _R) * x, _false_northing(crs) + F.lit(_K0 * _R) * y


def utm_inverse(easting: Column, northing: Column, crs: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    zone = utm_zone(crs)
    xi, eta = (northing - _false_northing(crs)) / (_K0 * _R), (easting - 500_000.0) / (_K0 * _R)
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (zone * 6 - 183)


def _false_northing(crs: Column) -> Column:
    return F.when(F.substring(crs, 8, 1) == "7", 10_000_000.0).otherwise(0.0)
