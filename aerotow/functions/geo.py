"""Great-circle geometry as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors used by the features.
M_TO_NM = 0.000539957
FT_TO_M = 0.3048
KT_TO_MS = 0.514444
LB_TO_KG = 0.453592
EARTH_RADIUS_M = 6378137.0      # default radius of the R haversine
EARTH_RADIUS_KM = 6371.0        # radius of the tabular haversine


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS_M) -> Column:
    """Distance in metres; null when any coordinate is null.

    ``least(1, .)`` skips nulls, so the explicit guard is needed to keep a
    missing neighbour from turning into half the earth's circumference.
    """
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = p2 - p1
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    d = F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    ok = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    return F.when(ok, d)


def haversine_nm(lon1, lat1, lon2, lat2) -> Column:
    return F.lit(M_TO_NM) * haversine_m(lon1, lat1, lon2, lat2)


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Airport-to-airport distance in km (atan2 form)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = p2 - p1
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(radius) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlon = F.radians(lon2) - F.radians(lon1)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    deg = F.degrees(F.atan2(y, x))
    return F.pmod(deg + 360, F.lit(360.0))
