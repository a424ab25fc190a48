"""Spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import crs
from tidemark.operators import joins as J
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

_T = with_views("transects")
_AREAS = "areas AS (SELECT s_suppkey AS area_id, CASE WHEN s_suppkey % 13 <> 0 THEN (s_suppkey * 71) % 3500 / 1e1 - 18e1 END AS xmin, (s_suppkey * 29) % 1500 / 1e1 - 8e1 AS ymin, (s_suppkey * 71) % 3500 / 1e1 - 18e1 + 6 AS xmax, (s_suppkey * 29) % 1500 / 1e1 - 8e1 + 4 AS ymax FROM supplier)"
_MEET = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


def _areas(spark, d):
    s = fx.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    x, y = (k * 71) % 3500 / 10.0 - 180.0, (k * 29) % 1500 / 10.0 - 80.0
    return s.select(k.alias("area_id"), F.when(k % 13 != 0, x).alias("xmin"), y.alias("ymin"), (x + 6).alias("xmax"), (y + 4).alias("ymax"))


@query(f"{_T}, {_AREAS} SELECT a.area_id, b.id FROM areas a JOIN transects b ON {_MEET}")
def spatial_join_tiles(spark, d):
    return J.box_join(_areas(spark, d).where("xmin is not null"), fx.transects(spark, d), "area_id", "id").select("area_id", "id")


@query(f"{_T}, {_AREAS} SELECT a.area_id, CASE WHEN a.xmin IS NOT NULL THEN count(b.id) END AS n FROM areas a LEFT JOIN transects b ON {_MEET} GROUP BY a.area_id, a.xmin")
def building_count(spark, d):
    return J.count_within(_areas(spark, d), fx.transects(spark, d), "area_id", "id").select("area_id", "n")


@query(
    f"""{with_views('items')}, {_AREAS}, o AS (SELECT a.area_id, b.item_id, greatest(a.xmin, b.xmin) AS x0, greatest(a.ymin, b.ymin) AS y0, least(a.xmax, b.xmax) AS x1, least(a.ymax, b.ymax) AS y1 FROM areas a JOIN items b ON {_MEET})
SELECT area_id, item_id, {q('(x1 - x0) * (y1 - y0)')} AS area FROM o WHERE (x1 - x0) * (y1 - y0) > 0"""
)
def box_overlay(spark, d):
    return J.overlay_boxes(_areas(spark, d).where("xmin is not null"), fx.items(spark, d), "area_id", "item_id").select("area_id", "item_id", r("area").alias("area"))


def _merc(lon: str, lat: str) -> str:
    return f"radians({lon}) * 6378137e0 AS x, ln(tan(radians({lat}) / 2 + pi() / 4)) * 6378137e0 AS y"


@query(
    f"""{_T}, {_AREAS}, a AS (SELECT id, {_merc('lon', 'lat')} FROM transects), b AS (SELECT area_id, {_merc('xmin', 'ymin')} FROM areas WHERE xmin IS NOT NULL),
p AS (SELECT id, area_id, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS dist FROM a, b WHERE abs(b.x - a.x) <= 4e5 AND abs(b.y - a.y) <= 4e5),
n AS (SELECT id, area_id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, area_id) AS k FROM p WHERE dist <= 4e5)
SELECT a.id, n.area_id, {q('n.dist', 2)} AS distance FROM a LEFT JOIN n ON a.id = n.id AND n.k = 1"""
)
def nearest_attribute(spark, d):
    a = fx.transects(spark, d).select("id", crs.mercator("lon", "lat").alias("p")).select("id", "p.x", "p.y")
    b = _areas(spark, d).where("xmin is not null").select("area_id", crs.mercator("xmin", "ymin").alias("p")).select("area_id", "p.x", "p.y")
    return J.nearest(a, b, "id", "area_id", 400_000.0).select("id", "area_id", r("distance", 2).alias("distance"))


@query(f"{_T} SELECT id, {q('sqrt(power(lon - 5, 2) + power(lat - 52, 2))')} AS distance FROM transects ORDER BY distance, id LIMIT 5")
def nearest_five(spark, d):
    """Top five: the limit is what is asked for."""
    t = fx.transects(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return J.nearest_one(t, 5.0, 52.0, 5).select("id", r("distance").alias("distance"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_per_key(spark, d):
    return J.first_per_key(fx.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


# (the polygon is convex and runs anticlockwise: a segment meets it if the part within all half-planes is not empty)
_HEX = ((20.0, 0.0), (40.0, 30.0), (0.0, 60.0), (-40.0, 30.0), (-20.0, 0.0))


_EDGES = ", ".join(f"({k}, {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for k, (a, b) in enumerate(zip(_HEX, (*_HEX[1:], _HEX[0]))))


@query(
    f"""{_T}, e AS (SELECT * FROM (VALUES {_EDGES}) AS v(k, ax, ay, bx, cy)),
c AS (SELECT id, (bx - ax) * (ymin - ay) - (cy - ay) * (xmin - ax) AS c0, (bx - ax) * (ymax - ymin) - (cy - ay) * (xmax - xmin) AS c1 FROM transects, e),
t AS (SELECT id, greatest(0e0, max(CASE WHEN c1 > 0 THEN -c0 / c1 END)) AS low, least(1e0, min(CASE WHEN c1 < 0 THEN -c0 / c1 END)) AS high, bool_or(c1 = 0 AND c0 < 0) AS out FROM c GROUP BY id)
SELECT id FROM t WHERE low <= high AND NOT out"""
)
def polygon_intersects(spark, d):
    """Lines that meet a polygon: bounds first, the exact test in Arrow batches."""
    from tidemark.functions.planar import point
    from tidemark.functions.wkb import intersects_polygon, line_wkb
    from tidemark.operators.scan import overlaps

    t = fx.transects(spark, d).where(overlaps((-40.0, 0.0, 40.0, 60.0), "xmin", "ymin", "xmax", "ymax"))
    t = t.select("id", line_wkb(F.array(point("xmin", "ymin"), point("xmax", "ymax"))).alias("geometry"))
    return t.where(intersects_polygon(_HEX)("geometry")).select("id")


@query()
def clip_lines(spark, d):
    from tidemark.functions.wkb import clip_lines as clip
    from tidemark.functions.wkb import line_wkb

    t = fx.lines(spark, d).where(F.size("line") > 1).select("country", clip(_HEX)(line_wkb("line")).alias("geometry"))
    return t.where("geometry is not null").select("country", F.octet_length("geometry").alias("bytes"))
