"""Angles, planar distances, grid indices, fuel and friction rules, map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.base import clip, col, dbl, half_even

# Compass labels, spread-suppression thresholds (kW/m), metres per degree.
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
SUPPRESSION_KW_M = [350.0, 1750.0, 3500.0]
METRES_PER_DEGREE = 111_320.0
# Friction band (m) and maximum extra cost beside the fire.
FRICTION_BAND_M = 1500.0
FRICTION_EXTRA = 4.0


def bearing(dx, dy) -> Column:
    """Compass bearing in degrees of a planar offset."""
    return F.pmod(F.degrees(F.atan2(dbl(dx), dbl(dy))) + 360.0, F.lit(360.0))


def ang_diff(a, b) -> Column:
    """Smallest absolute difference of two bearings."""
    return F.abs(F.pmod(dbl(a) - dbl(b) + 180.0, F.lit(360.0)) - 180.0)


def blows_to(wd_from) -> Column:
    return F.pmod(dbl(wd_from) + 180.0, F.lit(360.0))


def wind_u(ws, wd_from) -> Column:
    return -dbl(ws) * F.sin(F.radians(dbl(wd_from)))


def wind_v(ws, wd_from) -> Column:
    return -dbl(ws) * F.cos(F.radians(dbl(wd_from)))


def wind_from_uv(u, v) -> Column:
    return bearing(-dbl(u), -dbl(v))


def compass(wd) -> Column:
    """Eight-point label of a bearing."""
    idx = F.pmod(half_even(dbl(wd) / 45.0), F.lit(8)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in COMPASS]), idx + 1)


def planar_m(lat1, lon1, lat2, lon2, cos_lat=None) -> Column:
    """Flat-earth metres; longitudes shrink with ``cos_lat`` (default: the mean latitude)."""
    a, b = dbl(lat1), dbl(lat2)
    shrink = F.cos(F.radians((a + b) / 2.0 if cos_lat is None else dbl(cos_lat)))
    return F.hypot((a - b) * METRES_PER_DEGREE, (dbl(lon1) - dbl(lon2)) * METRES_PER_DEGREE * shrink)


def cell_id(row, column, ncols) -> Column:
    """1-based row-major cell number."""
    return col(row).cast("long") * col(ncols) + col(column).cast("long") + 1


def cell_row(cell, ncols) -> Column:
    return F.floor((col(cell) - 1) / col(ncols)).cast("long")


def cell_col(cell, ncols) -> Column:
    return F.pmod(col(cell) - 1, col(ncols)).cast("long")


def cell_x(column, x0, size) -> Column:
    return dbl(x0) + (dbl(column) + 0.5) * dbl(size)


def cell_y(row, y_top, size) -> Column:
    return dbl(y_top) - (dbl(row) + 0.5) * dbl(size)


def slope_factor(slope_deg) -> Column:
    return 1.0 + clip(slope_deg, 0.0, 45.0) / 45.0


def buffer_width(fuel_weight, slope_deg) -> Column:
    """Danger-zone width in metres of one cell."""
    return clip(100.0 + (dbl(fuel_weight) * slope_factor(slope_deg) - 0.3) * 300.0, 100.0, 600.0)


def friction(length_m, distance_m) -> Column:
    """Edge cost: length times the proximity penalty; a null distance is beyond the band."""
    near = clip(1.0 - F.coalesce(dbl(distance_m), F.lit(FRICTION_BAND_M)) / FRICTION_BAND_M, 0.0, 1.0)
    return dbl(length_m) * (1.0 + FRICTION_EXTRA * near)


def supp_class(intensity) -> Column:
    """0 when nothing burns, else 1 plus the number of thresholds reached."""
    v = dbl(intensity)
    hits = sum(((v >= t).cast("int") for t in SUPPRESSION_KW_M), F.lit(1))
    return F.when(v > 0, hits).otherwise(0)


def signed(distance, inside, flag) -> Column:
    """Positive where the simulation lies beyond reality."""
    d = dbl(distance)
    return F.when(col(inside) == col(flag), d).otherwise(-d)


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point to a segment."""
    px, py, x1, y1, x2, y2 = (dbl(c) for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, clip(((px - x1) * dx + (py - y1) * dy) / len2, 0.0, 1.0)).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


# GRS80 / WGS84 axes and flattening, Greek Grid (EPSG:2100) parameters and
# its published geocentric shift to WGS84 in metres.
_A = 6378137.0
_F_GRS80, _F_WGS84 = 1 / 298.257222101, 1 / 298.257223563
_LON0, _K0, _FE = 24.0, 0.9996, 500000.0
_SHIFT = (-199.87, 74.79, 246.62)


def _geocentric(lat: Column, lon: Column, flat: float):
    e2 = flat * (2 - flat)
    n = _A / F.sqrt(1.0 - e2 * F.sin(lat) * F.sin(lat))
    return n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat)


def _geodetic(df: DataFrame, x: Column, y: Column, z: Column, flat: float) -> DataFrame:
    """Adds _lat and _lon by Bowring's closed form (error far below a millimetre)."""
    e2 = flat * (2 - flat)
    b = _A * (1 - flat)
    ep2 = e2 / (1 - e2)
    df = df.withColumns({"_gx": x, "_gy": y, "_gz": z})
    df = df.withColumn("_p", F.hypot("_gx", "_gy"))
    df = df.withColumn("_th", F.atan2(F.col("_gz") * _A, F.col("_p") * b))
    s, c = F.sin("_th"), F.cos("_th")
    lat = F.atan2(F.col("_gz") + ep2 * b * s * s * s, F.col("_p") - e2 * _A * c * c * c)
    return df.withColumns({"_lat": lat, "_lon": F.atan2(F.col("_gy"), F.col("_gx"))})


_TEMP = ["_gx", "_gy", "_gz", "_p", "_th", "_lat", "_lon", "_t", "_xi0", "_eta0", "_chi", "_ox", "_oy", "_oz"]


def to_2100(df: DataFrame, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y") -> DataFrame:
    """WGS84 degrees to Greek Grid metres over a whole table, by Krueger's series.

    Steps are separate projections so that no step's expression is repeated in the next.
    """
    gx, gy, gz = _geocentric(F.radians(dbl(lat)), F.radians(dbl(lon)), _F_WGS84)
    df = df.withColumns({"_ox": gx - _SHIFT[0], "_oy": gy - _SHIFT[1], "_oz": gz - _SHIFT[2]})
    df = _geodetic(df, F.col("_ox"), F.col("_oy"), F.col("_oz"), _F_GRS80)
    n, big_a, alpha, _, _ = _krueger()
    k = 2 * math.sqrt(n) / (1 + n)
    s = F.sin("_lat")
    dl = F.col("_lon") - math.radians(_LON0)
    df = df.withColumn("_t", F.sinh(F.atanh(s) - k * F.atanh(k * s)))
    df = df.withColumns({"_xi0": F.atan2(F.col("_t"), F.cos(dl)),
                         "_eta0": F.atanh(F.sin(dl) / F.sqrt(1.0 + F.col("_t") * F.col("_t")))})
    xi, eta = F.col("_xi0"), F.col("_eta0")
    for j, a in enumerate(alpha, 1):
        xi = xi + a * F.sin(2 * j * F.col("_xi0")) * F.cosh(2 * j * F.col("_eta0"))
        eta = eta + a * F.cos(2 * j * F.col("_xi0")) * F.sinh(2 * j * F.col("_eta0"))
    return df.withColumns({x: _FE + _K0 * big_a * eta, y: _K0 * big_a * xi}).drop(*_TEMP)


def to_4326(df: DataFrame, x: str = "x", y: str = "y", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Greek Grid metres to WGS84 degrees over a whole table."""
    _, big_a, _, beta, delta = _krueger()
    df = df.withColumns({"_xi0": dbl(y) / (_K0 * big_a), "_eta0": (dbl(x) - _FE) / (_K0 * big_a)})
    xi, eta = F.col("_xi0"), F.col("_eta0")
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * F.col("_xi0")) * F.cosh(2 * j * F.col("_eta0"))
        eta = eta - b * F.cos(2 * j * F.col("_xi0")) * F.sinh(2 * j * F.col("_eta0"))
    df = df.withColumns({"_ox": xi, "_oy": eta})
    df = df.withColumn("_chi", F.asin(F.sin("_ox") / F.cosh("_oy")))
    phi = F.col("_chi")
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * F.col("_chi"))
    df = df.withColumns({"_lat": phi, "_lon": math.radians(_LON0) + F.atan2(F.sinh("_oy"), F.cos("_ox"))})
    gx, gy, gz = _geocentric(F.col("_lat"), F.col("_lon"), _F_GRS80)
    df = df.withColumns({"_ox": gx + _SHIFT[0], "_oy": gy + _SHIFT[1], "_oz": gz + _SHIFT[2]})
    df = _geodetic(df, F.col("_ox"), F.col("_oy"), F.col("_oz"), _F_WGS84)
    return df.withColumns({lat: F.degrees("_lat"), lon: F.degrees("_lon")}).drop(*_TEMP)


def _krueger():
    n = _F_GRS80 / (2 - _F_GRS80)
    big_a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, big_a, alpha, beta, delta
