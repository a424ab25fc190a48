"""Slippy-map tiles and quadkeys as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, bound, col, geojson_polygon


def tile_x(lon: ColumnOrName, zoom: int) -> Column:
    return ((col(lon) + 180) / 360 * float(2**zoom)).cast("bigint")


def tile_y(lat: ColumnOrName, zoom: int) -> Column:
    return ((1 - F.asinh(F.tan(F.radians(col(lat)))) / math.pi) / 2 * float(2**zoom)).cast("bigint")


def clamped(tile: Column, zoom: int) -> Column:
    """A tile number held within the map, for poles and edges."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(tile, F.lit(2**zoom - 1).cast("bigint")))


def corner_lon(x: Column, zoom: int) -> Column:
    """Western edge of a tile."""
    return x / float(2**zoom) * 360.0 - 180.0


def corner_lat(y: Column, zoom: int) -> Column:
    """Northern edge of a tile."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / float(2**zoom)))))


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Digits to base four, the coarsest level first: bit of x plus twice bit of y.  Their binary digits are read to base four, so that each is made once."""
    if not zoom:
        return F.lit("")
    spaced = lambda t: F.conv(F.bin(t.cast("bigint").bitwiseAND(F.lit(2**zoom - 1).cast("bigint"))), 4, 10).cast("bigint")
    return F.lpad(F.conv((spaced(x) + spaced(y) * 2).cast("string"), 10, 4), zoom, "0")


def quadkey_of(lon: ColumnOrName, lat: ColumnOrName, zoom: int = 12) -> Column:
    return quadkey(clamped(tile_x(lon, zoom), zoom), clamped(tile_y(lat, zoom), zoom), zoom)


def tile_of_quadkey(key: ColumnOrName) -> Column:
    """struct<x, y, zoom>."""
    key = col(key)
    digits = F.filter(F.split(key, ""), lambda d: d != "")
    zero = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).alias("zoom"))
    return F.aggregate(
        digits,
        zero,
        lambda t, d: F.struct((t["x"] * 2 + d.cast("bigint") % 2).alias("x"), (t["y"] * 2 + F.floor(d.cast("bigint") / 2)).alias("y"), (t["zoom"] + 1).alias("zoom")),
    )


def quadkey_box(key: ColumnOrName) -> Column:
    """struct<xmin, ymin, xmax, ymax> of a quadkey."""

    def box(t: Column) -> Column:
        n = F.pow(F.lit(2.0), t["zoom"])
        lat = lambda y: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))
        return F.struct((t["x"] / n * 360.0 - 180.0).alias("xmin"), lat(t["y"] + 1).alias("ymin"), ((t["x"] + 1) / n * 360.0 - 180.0).alias("xmax"), lat(t["y"]).alias("ymax"))

    return bound(tile_of_quadkey(key), box)


def quadkey_geojson(key: ColumnOrName) -> Column:
    return bound(quadkey_box(key), lambda b: geojson_polygon(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """Longest common prefix of two quadkeys of that length."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring(a, 1, k) == F.substring(b, 1, k)), k).otherwise(n))
    return F.substring(a, F.lit(1), same)


def bounding_quadkey(xmin: ColumnOrName, ymin: ColumnOrName, xmax: ColumnOrName, ymax: ColumnOrName, zoom: int = 12) -> Column:
    """Quadkey of the deepest tile, down to zoom, that holds a whole box."""
    tile = lambda lon, lat: F.struct(clamped(tile_x(lon, zoom), zoom).alias("x"), clamped(tile_y(lat, zoom), zoom).alias("y"))

    def key(s: Column) -> Column:
        differ = s["a"]["x"].bitwiseXOR(s["b"]["x"]).bitwiseOR(s["a"]["y"].bitwiseXOR(s["b"]["y"]))
        # the digits of 2 d + 1 are one more than those of d, and one for 0
        return F.substring(quadkey(s["a"]["x"], s["a"]["y"], zoom), F.lit(1), zoom + 1 - F.length(F.bin(differ * 2 + 1)))

    return bound(F.struct(tile(xmin, ymax).alias("a"), tile(xmax, ymin).alias("b")), key)


def all_tiles(spark: SparkSession, zoom: int) -> DataFrame:
    """Every tile of a zoom level: quadkey, x, y, zoom, name and box."""
    n = 2**zoom
    df = spark.range(n * n).select(F.floor(F.col("id") / n).alias("x"), (F.col("id") % n).alias("y"))
    x, y = F.col("x"), F.col("y")
    return df.select(
        quadkey(x, y, zoom).alias("quadkey"), "x", "y", F.lit(zoom).alias("zoom"), F.concat(F.lit(f"z{zoom}x"), x.cast("string"), F.lit("y"), y.cast("string")).alias("name"),
        corner_lon(x, zoom).alias("xmin"), corner_lat(y + 1, zoom).alias("ymin"), corner_lon(x + 1, zoom).alias("xmax"), corner_lat(y, zoom).alias("ymax"),
    )


def covering_tiles(xmin: ColumnOrName, ymin: ColumnOrName, xmax: ColumnOrName, ymax: ColumnOrName, zoom: int) -> Column:
    """array<bigint> of the numbers (x * 2^zoom + y) of all tiles that a box touches."""
    n = 2**zoom
    xs = F.sequence(clamped(tile_x(xmin, zoom), zoom), clamped(tile_x(xmax, zoom), zoom))
    ys = F.sequence(clamped(tile_y(ymax, zoom), zoom), clamped(tile_y(ymin, zoom), zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: x * n + y)))
