"""Coordinate reference systems as column expressions: EPSG:4326, 3857 and the UTM zones (326zz, 327zz).

Transverse Mercator uses the series in the third flattening to order six (Karney 2011), whose error is far below a
millimetre inside a zone.  The coefficients are computed here from the ellipsoid.
"""

from __future__ import annotations

import math
from fractions import Fraction as Q

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, bound, col, point

#: WGS 84 and UTM: fixed values.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Coefficients of the published series, by power of n from n^j: fixed values.
FORWARD = (
    (Q(1, 2), Q(-2, 3), Q(5, 16), Q(41, 180), Q(-127, 288), Q(7891, 37800)),
    (Q(13, 48), Q(-3, 5), Q(557, 1440), Q(281, 630), Q(-1983433, 1935360)),
    (Q(61, 240), Q(-103, 140), Q(15061, 26880), Q(167603, 181440)),
    (Q(49561, 161280), Q(-179, 168), Q(6601661, 7257600)),
    (Q(34729, 80640), Q(-3418889, 1995840)),
    (Q(212378941, 319334400),),
)
BACKWARD = (
    (Q(1, 2), Q(-2, 3), Q(37, 96), Q(-1, 360), Q(-81, 512), Q(96199, 604800)),
    (Q(1, 48), Q(1, 15), Q(-437, 1440), Q(46, 105), Q(-1118711, 3870720)),
    (Q(17, 480), Q(-37, 840), Q(-209, 4480), Q(5569, 90720)),
    (Q(4397, 161280), Q(-11, 504), Q(-830251, 7257600)),
    (Q(4583, 161280), Q(-108847, 3991680)),
    (Q(20648693, 638668800),),
)


def coefficients(table) -> list[float]:
    return [sum(float(c) * N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]


ALPHA, BETA = coefficients(FORWARD), coefficients(BACKWARD)


def mercator(lon: ColumnOrName, lat: ColumnOrName) -> Column:
    """EPSG:3857."""
    lon, lat = col(lon), col(lat)
    return point(F.radians(lon) * SEMI_MAJOR, F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * SEMI_MAJOR)


def mercator_inverse(x: ColumnOrName, y: ColumnOrName) -> Column:
    return point(F.degrees(col(x) / SEMI_MAJOR), F.degrees(F.atan(F.sinh(col(y) / SEMI_MAJOR))))


def utm_zone(lon: ColumnOrName) -> Column:
    """Zone 1 to 60 of a longitude, without the exceptions around Norway and Svalbard."""
    return (F.pmod(F.floor((col(lon) + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_epsg(lon: ColumnOrName, lat: ColumnOrName) -> Column:
    return F.when(col(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def epsg_of_mgrs(tile: ColumnOrName) -> Column:
    """EPSG code from an MGRS tile name: two digits of the zone, and a band from N on for the north; NULL if too short."""
    t = col(tile)
    north = F.upper(F.substring(t, 3, 1)) >= "N"
    return F.when(F.length(t) >= 3, F.when(north, F.lit(32600)).otherwise(F.lit(32700)) + F.substring(t, 1, 2).try_cast("int"))


def utm(lon: ColumnOrName, lat: ColumnOrName, epsg: ColumnOrName) -> Column:
    """Easting and northing in the zone of that EPSG code."""
    lon, lat, epsg = col(lon), col(lat), col(epsg)
    away = F.radians(lon - ((epsg % 100) * 6 - 183))
    s = F.sin(F.radians(lat))
    conformal = F.atanh(s) - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * s)
    xi = F.atan2(F.sinh(conformal), F.cos(away))
    eta = F.atanh(F.sin(away) / F.cosh(conformal))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        north = north + a * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        east = east + a * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    south = F.when(F.floor(epsg / 100) == 327, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))
    return point(east * (SCALE * RECTIFYING) + FALSE_EAST, north * (SCALE * RECTIFYING) + south)


def utm_line(line: ColumnOrName, epsg: ColumnOrName) -> Column:
    """utm() for each point of an array, step by step."""
    epsg = col(epsg)
    e = F.lit(ECCENTRICITY)
    south = F.when(F.floor(epsg / 100) == 327, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))

    def second(p: Column) -> Column:
        both = lambda c: F.struct(F.atan2(F.sinh(c), F.cos(p["away"])).alias("xi"), F.atanh(F.sin(p["away"]) / F.cosh(c)).alias("eta"))
        return bound(F.atanh(p["s"]) - e * F.atanh(e * p["s"]), both)

    def third(p: Column) -> Column:
        east, north = p["eta"], p["xi"]
        for j, a in enumerate(ALPHA, 1):
            north = north + a * F.sin(p["xi"] * (2 * j)) * F.cosh(p["eta"] * (2 * j))
            east = east + a * F.cos(p["xi"] * (2 * j)) * F.sinh(p["eta"] * (2 * j))
        return point(east * (SCALE * RECTIFYING) + FALSE_EAST, north * (SCALE * RECTIFYING) + south)

    steps = F.transform(col(line), lambda p: F.struct(F.radians(p["x"] - ((epsg % 100) * 6 - 183)).alias("away"), F.sin(F.radians(p["y"])).alias("s")))
    return F.transform(F.transform(steps, second), third)


def _rectified(x: Column, y: Column, epsg: Column) -> Column:
    south = F.when(F.floor(epsg / 100) == 327, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))
    return F.struct(((y - south) / (SCALE * RECTIFYING)).alias("xi"), ((x - FALSE_EAST) / (SCALE * RECTIFYING)).alias("eta"))


def _spherical(p: Column) -> Column:
    xi, eta = p["xi"], p["eta"]
    north, east = xi, eta
    for j, b in enumerate(BETA, 1):
        north = north - b * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        east = east - b * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    return F.struct(north.alias("n"), east.alias("e"))


def _conformal(p: Column) -> Column:
    sine = F.sin(p["n"]) / F.cosh(p["e"])
    return F.struct(F.atanh(sine).alias("q"), F.asin(sine).alias("lat"), F.degrees(F.atan2(F.sinh(p["e"]), F.cos(p["n"]))).alias("away"))


def _geographic(p: Column, epsg: Column) -> Column:
    """The conformal latitude is undone by its fixed point, which gains over two digits a step."""
    lat = p["lat"]
    for _ in range(6):
        lat = F.atan(F.sinh(p["q"] + F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * F.sin(lat))))
    return point(p["away"] + ((epsg % 100) * 6 - 183), F.degrees(lat))


def utm_inverse(x: ColumnOrName, y: ColumnOrName, epsg: ColumnOrName) -> Column:
    """Longitude and latitude of a place in a zone."""
    return F.get(utm_inverse_line(F.array(point(x, y)), epsg), F.lit(0))


def utm_inverse_line(line: ColumnOrName, epsg: ColumnOrName) -> Column:
    """The same for each point of an array.  Each step is bound by a transform of its own: written into one another they would be evaluated many times."""
    epsg = col(epsg)
    steps = F.transform(col(line), lambda p: _rectified(p["x"], p["y"], epsg))
    steps = F.transform(F.transform(steps, _spherical), _conformal)
    return F.transform(steps, lambda p: _geographic(p, epsg))


def convert(x: ColumnOrName, y: ColumnOrName, source: int | Column, target: int | Column) -> Column:
    """x, y from one of 4326, 3857 or a UTM zone to another."""
    geographic = point(x, y) if _is(source, 4326) else mercator_inverse(x, y) if _is(source, 3857) else utm_inverse(x, y, _lit(source))
    if _is(target, 4326):
        return geographic
    return mercator(geographic["x"], geographic["y"]) if _is(target, 3857) else utm(geographic["x"], geographic["y"], _lit(target))


def _is(code: int | Column, what: int) -> bool:
    return isinstance(code, int) and code == what


def _lit(code: int | Column) -> Column:
    return F.lit(code) if isinstance(code, int) else code


def azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Forward azimuth in [0, 360) on the ellipsoid, by Vincenty's inverse formula with a fixed number of steps (NULL for equal points)."""
    b = 1 - FLATTENING
    u1, u2 = F.atan(b * F.tan(F.radians(lat1))), F.atan(b * F.tan(F.radians(lat2)))
    away = F.radians(lon2 - lon1)
    state = F.struct(away.alias("l"))

    def step(lam: Column) -> Column:
        p, q = F.cos(u2) * F.sin(lam), F.cos(u1) * F.sin(u2) - F.sin(u1) * F.cos(u2) * F.cos(lam)
        sin_s = F.sqrt(p * p + q * q)
        cos_s = F.sin(u1) * F.sin(u2) + F.cos(u1) * F.cos(u2) * F.cos(lam)
        s = F.atan2(sin_s, cos_s)
        sin_a = F.coalesce(F.try_divide(F.cos(u1) * F.cos(u2) * F.sin(lam), sin_s), F.lit(0.0))
        cos2 = 1 - sin_a * sin_a
        mid = cos_s - F.coalesce(F.try_divide(2 * F.sin(u1) * F.sin(u2), cos2), F.lit(0.0))
        c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        return away + (1 - c) * FLATTENING * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))

    lam = F.aggregate(F.sequence(F.lit(1), F.lit(12)), state, lambda t, _: F.struct(step(t["l"]).alias("l")))["l"]
    p, q = F.cos(u2) * F.sin(lam), F.cos(u1) * F.sin(u2) - F.sin(u1) * F.cos(u2) * F.cos(lam)
    return F.when((lon1 != lon2) | (lat1 != lat2), F.pmod(F.degrees(F.atan2(p, q)), F.lit(360.0)))
