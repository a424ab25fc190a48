"""Tiles and quadkeys."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.functions import tiles as tl
from tidemark.operators import grids
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views


def _x(lon: str, z: int) -> str:
    return f"greatest(0, least({2**z - 1}, CAST(trunc(({lon} + 18e1) / 36e1 * {float(2**z)}e0) AS BIGINT)))"


def _y(lat: str, z: int) -> str:
    return f"greatest(0, least({2**z - 1}, CAST(trunc((1 - asinh(tan(radians({lat}))) / pi()) / 2 * {float(2**z)}e0) AS BIGINT)))"


def _key(x: str, y: str, z: int) -> str:
    return f"array_to_string(list_transform(range({z - 1}, -1, -1), lambda k: CAST((({x} >> k) & 1) + 2 * (({y} >> k) & 1) AS VARCHAR)), '')"


Z = 12
_XY = f"xy AS (SELECT *, {_x('lon', Z)} AS x, {_y('lat', Z)} AS y FROM transects)"


@query(f"{with_views('transects')}, {_XY} SELECT id, x, y, {_key('x', 'y', Z)} AS quadkey FROM xy")
def quadkey_z12(spark, d):
    t = fx.transects(spark, d).select("id", tl.clamped(tl.tile_x("lon", Z), Z).alias("x"), tl.clamped(tl.tile_y("lat", Z), Z).alias("y"))
    return t.withColumn("quadkey", tl.quadkey(F.col("x"), F.col("y"), Z))


@query(f"{with_views('transects')}, {_XY} SELECT id, {q('x / 4096e0 * 36e1 - 18e1')} AS xmin, {q('degrees(atan(sinh(pi() * (1 - 2 * y / 4096e0))))')} AS ymax FROM xy")
def tile_corner(spark, d):
    t = fx.transects(spark, d).select("id", tl.clamped(tl.tile_x("lon", Z), Z).alias("x"), tl.clamped(tl.tile_y("lat", Z), Z).alias("y"))
    return t.select("id", r(tl.corner_lon(F.col("x"), Z)).alias("xmin"), r(tl.corner_lat(F.col("y"), Z)).alias("ymax"))


@query(f"{with_views('transects')}, {_XY} SELECT id, x, y, CAST({Z} AS INT) AS zoom FROM xy")
def quadkey_roundtrip(spark, d):
    t = fx.transects(spark, d).select("id", tl.tile_of_quadkey(tl.quadkey_of("lon", "lat", Z)).alias("t"))
    return t.select("id", "t.x", "t.y", "t.zoom")


_BOX_KEYS = f"{_key('x0', 'y0', Z)} AS a, {_key('x1', 'y1', Z)} AS b"


@query(
    f"""{with_views('transects')}, w AS (SELECT id, {_x('(lon - 1e0)', Z)} AS x0, {_y('(lat + 1e0)', Z)} AS y0, {_x('(lon + 1e0)', Z)} AS x1, {_y('(lat - 1e0)', Z)} AS y1 FROM transects),
k AS (SELECT id, {_BOX_KEYS} FROM w)
SELECT id, substr(a, 1, list_max(list_transform(range(0, {Z + 1}), lambda n: CASE WHEN substr(a, 1, n) = substr(b, 1, n) THEN n ELSE 0 END))) AS bounding_quadkey FROM k"""
)
def bounding_quadkey(spark, d):
    t = fx.transects(spark, d)
    return t.select("id", tl.bounding_quadkey(F.col("lon") - 1.0, F.col("lat") - 1.0, F.col("lon") + 1.0, F.col("lat") + 1.0, Z).alias("bounding_quadkey"))


@query(
    f"""WITH t AS (SELECT i // 16 AS x, i % 16 AS y FROM range(256) AS g(i))
SELECT {_key('x', 'y', 4)} AS quadkey, x, y, 'z4x' || x || 'y' || y AS name, {q('x / 16e0 * 36e1 - 18e1')} AS xmin, {q('degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 16e0))))')} AS ymin,
  {q('(x + 1) / 16e0 * 36e1 - 18e1')} AS xmax, {q('degrees(atan(sinh(pi() * (1 - 2 * y / 16e0))))')} AS ymax FROM t"""
)
def all_tiles_zoom4(spark, d):
    return tl.all_tiles(spark, 4).select("quadkey", "x", "y", "name", *[r(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(
    f"""{with_views('transects')}, {_XY}, k AS (SELECT {_key('x', 'y', Z)} AS key, rate FROM xy), z AS (SELECT unnest([7, 5, 3]) AS zoom)
SELECT CAST(zoom AS INT) AS zoom, substr(key, 1, zoom) AS cell, {q('avg(rate)', 9)} AS mean, count(rate) AS n FROM k, z GROUP BY zoom, substr(key, 1, zoom)"""
)
def quadkey_rollup(spark, d):
    t = fx.transects(spark, d).select(tl.quadkey_of("lon", "lat", Z).alias("key"), "rate")
    return grids.roll_up(t, "key", "rate", (7, 5, 3)).select("zoom", "cell", r("mean", 9).alias("mean"), "n")


