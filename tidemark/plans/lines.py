"""Parts, splits and moves of lines, GeoJSON, buffers of points, tiles as boxes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import crs, lines, planar
from tidemark.functions import tiles as tl
from tidemark.functions.planar import point
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

_T = with_views("transects")
#: A bent line of two segments for each transect.
_BENT = f"{_T}, bent AS (SELECT id, lon AS x0, lat AS y0, lon + (id % 4) + 1e0 AS x1, lat AS y1, lon + (id % 4) + 1e0 AS x2, lat + (id % 3) + 2e0 AS y2, (id % 4) + 1e0 AS a, (id % 3) + 2e0 AS b FROM transects)"


def _bent(spark, d):
    k = F.col("id")
    t = fx.transects(spark, d)
    x1, y2 = F.col("lon") + (k % 4) + 1.0, F.col("lat") + (k % 3) + 2.0
    return t.select("id", "lon", "lat", "country", F.array(point("lon", "lat"), point(x1, F.col("lat")), point(x1, y2)).alias("line"))


def _ends(c):
    return planar.first(c), planar.last(c)


@query(f"{_BENT} SELECT id, {q('x0 - 5e-1')} AS x0, {q('y0')} AS y0, {q('x2')} AS x1, {q('y2 + 5e-1')} AS y1, CAST(5 AS INT) AS n FROM bent")
def extended_line(spark, d):
    t = _bent(spark, d).select("id", planar.extend_line("line", F.lit(0.5)).alias("l"))
    a, z = _ends("l")
    return t.select("id", r(a["x"]).alias("x0"), r(a["y"]).alias("y0"), r(z["x"]).alias("x1"), r(z["y"]).alias("y1"), F.size("l").alias("n"))


@query(f"{_BENT} SELECT id, {q('x0')} AS first_x, {q('y2')} AS last_y FROM bent")
def line_ends(spark, d):
    a, z = _ends("line")
    return _bent(spark, d).select("id", r(a["x"]).alias("first_x"), r(z["y"]).alias("last_y"))


@query(f"{_T} SELECT id, {q('lon + 2e0 * cos(radians(CAST(id % 360 AS DOUBLE)))')} AS x, {q('lat + 2e0 * sin(radians(CAST(id % 360 AS DOUBLE)))')} AS y FROM transects")
def point_by_angle(spark, d):
    p = planar.point_at(point("lon", "lat"), (F.col("id") % 360).cast("double"), F.lit(2.0))
    return fx.transects(spark, d).select("id", p.alias("p")).select("id", r("p.x").alias("x"), r("p.y").alias("y"))


@query(f"{_BENT}, n AS (SELECT *, greatest(1, CAST(ceil((a + b - 1e-1) / 15e-1) AS INT)) AS n FROM bent) SELECT id, CAST(k AS INT) AS k, {q('CASE WHEN k = n - 1 THEN a + b - k * 15e-1 ELSE 15e-1 END')} AS length, {q('x0 + least(a, k * 15e-1)')} AS x, {q('y0 + greatest(0e0, k * 15e-1 - a)')} AS y FROM n, unnest(range(n)) AS u(k)")
def split_by_distance(spark, d):
    """Pieces of a length of 1.5, each with its first vertex."""
    t = lines.with_measures(fx.spread(_bent(spark, d)), "line").select("id", F.posexplode(lines.split_every("line", 1.5, "along")).alias("k", "piece"))
    return t.select("id", "k", r(planar.length("piece")).alias("length"), r(planar.first("piece")["x"]).alias("x"), r(planar.first("piece")["y"]).alias("y"))


@query(f"{_BENT} SELECT id, CAST(k AS INT) AS k, {q('CASE k WHEN 0 THEN a / 2 WHEN 1 THEN a / 2 + b / 2 ELSE b / 2 END')} AS length FROM bent, unnest(range(3)) AS u(k)")
def split_by_points(spark, d):
    """Places on either segment split; one far away, one at an end and one met twice do not."""
    t = lines.with_measures(fx.spread(_bent(spark, d)), "line")
    v = lambda k: F.get("line", F.lit(k))
    half = lambda a, b: point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    places = F.array(half(v(1), v(2)), half(v(0), v(1)), half(v(0), v(1)), v(0), point(v(0)["x"] - 9, v(0)["y"] - 9))
    t = t.withColumn("places", places).select("id", F.posexplode(lines.split_at("line", "places", "along")).alias("k", "piece"))
    return t.select("id", "k", r(planar.length("piece")).alias("length"))


@query(f"{_BENT} SELECT id, {q('x0')} AS x0, {q('y0 + 25e-2')} AS y0, {q('x1 - 25e-2')} AS x1, {q('y0 + 25e-2')} AS y1, {q('x2 - 25e-2')} AS x2, {q('y2')} AS y2 FROM bent")
def parallel_line(spark, d):
    """A quarter to the left: both segments moved, their carriers crossed."""
    t = fx.spread(_bent(spark, d)).select("id", lines.parallel("line", 0.25).alias("l"))
    return t.select("id", *[r(F.get("l", F.lit(k))[c]).alias(f"{c}{k}") for k in range(3) for c in "xy"])


@query(f"{_BENT} SELECT id, CAST(k AS INT) AS k, {q('CASE WHEN k = 0 THEN x0 ELSE x1 END')} AS lon, {q('CASE WHEN k = 2 THEN y2 ELSE y0 END')} AS lat FROM bent, unnest(range(3)) AS u(k)")
def line_vertices(spark, d):
    t = _bent(spark, d).select("id", F.posexplode("line").alias("k", "p"))
    return t.select("id", "k", r("p.x").alias("lon"), r("p.y").alias("lat"))


@query(f"{_BENT} SELECT id, {q('CASE WHEN (a + b) / 2 <= a THEN x0 + (a + b) / 2 ELSE x1 END')} AS x, {q('CASE WHEN (a + b) / 2 <= a THEN y0 ELSE y0 + (a + b) / 2 - a END')} AS y FROM bent")
def line_midpoint(spark, d):
    t = lines.with_measures(_bent(spark, d), "line").select("id", lines.midpoint("line", "along").alias("p"))
    return t.select("id", r("p.x").alias("x"), r("p.y").alias("y"))


@query(f"{_BENT} SELECT id, {q('a / 2')} AS length FROM bent")
def landward_side(spark, d):
    """From the first vertex to the middle of the first segment."""
    v = lambda k: F.get("line", F.lit(k))
    o = point((v(0)["x"] + v(1)["x"]) / 2, v(0)["y"])
    return _bent(spark, d).select("id", r(planar.length(lines.landward("line", o))).alias("length"))


@query(f"{_BENT} SELECT id, {q('x0')} AS xmin, {q('y0')} AS ymin, {q('x2')} AS xmax, {q('y2')} AS ymax FROM bent")
def geojson_bounds(spark, d):
    """Lines written as GeoJSON, and their bounds read from it."""
    c = F.transform("line", lambda p: F.array(p["x"], p["y"]))
    g = fx.spread(_bent(spark, d)).select("id", lines.geojson_bbox(F.to_json(F.struct(F.lit("LineString").alias("type"), c.alias("coordinates")))).alias("b"))
    return g.select("id", *[r(F.get("b", F.lit(k))).alias(n) for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))])


@query(f"{_T} SELECT id, {q('xmax')} AS x0, {q('ymin')} AS y0, 'Polygon' AS type, CAST(5 AS INT) AS n FROM transects")
def box_geojson(spark, d):
    """Rings of boxes as GeoJSON, from the lower right corner."""
    g = fx.transects(spark, d).select("id", planar.geojson_polygon(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("g"))
    ring = F.from_json(F.get_json_object("g", "$.coordinates[0]"), "array<array<double>>")
    g = g.select("id", F.get_json_object("g", "$.type").alias("type"), ring.alias("ring"))
    return g.select("id", r(F.col("ring")[0][0]).alias("x0"), r(F.col("ring")[0][1]).alias("y0"), "type", F.size("ring").alias("n"))


_AREA = 64 / 2 * math.sin(2 * math.pi / 64) * 500.0**2


@query(f"{_T} SELECT id, round({_AREA!r}, 2) + 0e0 AS area, {q('lon', 4)} AS lon, {q('lat', 4)} AS lat FROM transects")
def buffer_area(spark, d):
    """A circle of 500 m about each place in its UTM zone, as a ring of 64 segments: its area, and its centre back in degrees."""
    t = fx.transects(spark, d).withColumn("epsg", crs.utm_epsg("lon", "lat")).withColumn("p", crs.utm("lon", "lat", "epsg"))
    t = t.select("id", "epsg", lines.regular_buffer(F.col("p"), 500.0).alias("ring"))
    b = planar.bounds("ring")
    # about the first vertex, so that large coordinates do not eat the digits
    near = F.transform("ring", lambda v: point(v["x"] - F.get("ring", F.lit(0))["x"], v["y"] - F.get("ring", F.lit(0))["y"]))
    t = t.select("id", "epsg", r(planar.area(near), 2).alias("area"), ((b["xmin"] + b["xmax"]) / 2).alias("x"), ((b["ymin"] + b["ymax"]) / 2).alias("y"))
    return t.withColumn("g", crs.utm_inverse("x", "y", "epsg")).select("id", "area", r("g.x", 4).alias("lon"), r("g.y", 4).alias("lat"))


@query(f"{_T} SELECT id FROM transects WHERE 18e1 - abs(lon) <= 5e0")
def near_antimeridian(spark, d):
    return fx.transects(spark, d).where(lines.antimeridian_near("lon", 5.0)).select("id")


@query(f"{_T}, m AS (SELECT id, radians(1e-2) * 6378137e0 AS w, (ln(tan(radians(lat + 1e-2) / 2 + pi() / 4)) - ln(tan(radians(lat) / 2 + pi() / 4))) * 6378137e0 AS h FROM transects) SELECT id, {q('sqrt(w * w + h * h)', 3)} AS length FROM m")
def length_in_mercator(spark, d):
    """Length in another reference system of a line in degrees."""
    ends = F.array(point("lon", "lat"), point(F.col("lon") + 0.01, F.col("lat") + 0.01))
    t = fx.transects(spark, d).select("id", F.transform(ends, lambda p: crs.mercator(p["x"], p["y"])).alias("l"))
    return t.select("id", r(planar.length("l"), 3).alias("length"))


@query(f"{_T} SELECT id FROM transects WHERE country LIKE '%A%' AND (id % 4) + 1e0 + (id % 3) + 2e0 > 5e0")
def length_threshold(spark, d):
    return _bent(spark, d).where(F.col("country").contains("A") & (planar.length("line") > 5)).select("id")


@query(f"{_T} SELECT id FROM transects WHERE id % 3 <> 0")
def geometry_type_filter(spark, d):
    """Rows whose WKB is a polygon or multipolygon, by the type in its head."""
    from tidemark.functions.wkb import is_polygonal

    kind = F.when(F.col("id") % 3 == 0, F.lit("0101000000")).when(F.col("id") % 3 == 1, F.lit("0103000000")).otherwise(F.lit("0000000006"))
    t = fx.transects(spark, d).select("id", F.unhex(F.concat(kind, F.lit("00000000"))).alias("geometry"))
    return t.where(is_polygonal("geometry")).select("id")


_Z = 6
_X = f"greatest(0, least({2**_Z - 1}, CAST(trunc((lon + 18e1) / 36e1 * {2**_Z}e0) AS BIGINT)))"
_Y = f"greatest(0, least({2**_Z - 1}, CAST(trunc((1 - asinh(tan(radians(lat))) / pi()) / 2 * {2**_Z}e0) AS BIGINT)))"


@query(f"{_T} SELECT DISTINCT {_X} AS x, {_Y} AS y, 'z{_Z}x' || {_X} || 'y' || {_Y} AS name FROM transects")
def named_tiles(spark, d):
    """The tiles in which there is any place, with the names of their boxes."""
    x, y = tl.clamped(tl.tile_x("lon", _Z), _Z), tl.clamped(tl.tile_y("lat", _Z), _Z)
    t = fx.transects(spark, d).select(x.alias("x"), y.alias("y")).distinct()
    return t.withColumn("name", F.concat(F.lit(f"z{_Z}x"), F.col("x").cast("string"), F.lit("y"), F.col("y").cast("string")))


@query(f"SELECT 'z3x' || x || 'y' || y AS name, {q('radians(x / 8e0 * 36e1 - 18e1) * 6378137e0', 2)} AS west, {q('pi() * (1 - 2 * y / 8e0) * 6378137e0', 2)} AS north FROM range(8) AS a(x), range(8) AS b(y)")
def tiles_in_mercator(spark, d):
    """All tiles of a zoom level with the upper left corner of their boxes in EPSG:3857."""
    t = tl.all_tiles(spark, 3)
    return t.select("name", crs.mercator("xmin", "ymax").alias("p")).select("name", r("p.x", 2).alias("west"), r("p.y", 2).alias("north"))


@query(f"{_T}, t AS (SELECT id, {_X} AS x FROM transects) SELECT id, {q(f'(x + 1) / {2**_Z}e0 * 36e1 - 18e1')} AS east, {q(f'x / {2**_Z}e0 * 36e1 - 18e1')} AS west FROM t")
def quadkey_feature(spark, d):
    """The box of a place's quadkey as a GeoJSON polygon."""
    t = fx.spread(fx.transects(spark, d)).select("id", tl.quadkey_geojson(tl.quadkey_of("lon", "lat", _Z)).alias("g"))
    b = lines.geojson_bbox("g")
    return t.select("id", b.alias("b")).select("id", r(F.col("b")[2]).alias("east"), r(F.col("b")[0]).alias("west"))


@query(f"SELECT id, CASE WHEN lon >= 18e1 THEN {2**_Z - 1} ELSE CAST(trunc((lon + 18e1) / 36e1 * {2**_Z}e0) AS BIGINT) END AS x, CASE WHEN lat >= 85e0 THEN 0 WHEN lat <= -85e0 THEN {2**_Z - 1} ELSE {2**_Z // 2} END AS y FROM (SELECT n_nationkey AS id, n_nationkey * 15e0 - 18e1 AS lon, CASE n_nationkey % 3 WHEN 0 THEN 899e-1 WHEN 1 THEN -899e-1 ELSE 0e0 END AS lat FROM nation)")
def tiles_at_edges(spark, d):
    """Places at the poles and on the antimeridian have tiles of the map's edge."""
    k = F.col("n_nationkey")
    lat = F.when(k % 3 == 0, 89.9).when(k % 3 == 1, -89.9).otherwise(0.0)
    t = fx.table(spark, d, "nation").select(k.alias("id"), (k * 15.0 - 180.0).alias("lon"), lat.alias("lat"))
    return t.select("id", tl.clamped(tl.tile_x("lon", _Z), _Z).alias("x"), tl.clamped(tl.tile_y("lat", _Z), _Z).alias("y"))


@query(f"{_T}, p AS (SELECT id, country, lon, lat FROM transects) SELECT country, count(*) AS n, {q('avg(lon)', 4)} AS x, {q('avg(lat)', 4)} AS y FROM p GROUP BY country")
def mean_places(spark, d):
    return fx.transects(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("n"), r(F.avg("lon"), 4).alias("x"), r(F.avg("lat"), 4).alias("y"))


_R = "rects AS (SELECT s_suppkey AS k, s_suppkey * 1e0 AS x, (s_suppkey % 7) * 1e0 AS y, 2e0 + s_suppkey % 3 AS w, 1e0 + s_suppkey % 4 AS h FROM supplier)"


@query(f"WITH {_R} SELECT k, {q('x + w / 2')} AS x, {q('y + h / 2')} AS y, {q('w * h')} AS area, {q('2 * (w + h)')} AS perimeter FROM rects")
def ring_measures(spark, d):
    """Centroid, area and perimeter of rings."""
    k = F.col("s_suppkey")
    x, y, w, h = k * 1.0, (k % 7) * 1.0, 2.0 + k % 3, 1.0 + k % 4
    t = fx.table(spark, d, "supplier").select(k.alias("k"), planar.box_ring(x, y, x + w, y + h).alias("ring"))
    t = t.withColumn("c", planar.centroid("ring"))
    return t.select("k", r("c.x").alias("x"), r("c.y").alias("y"), r(planar.area("ring")).alias("area"), r(planar.length("ring")).alias("perimeter"))


@query(
    f"""{_T}, k AS (SELECT id, {_X} AS x, {_Y} AS y FROM transects) SELECT id, array_to_string(list_transform(range({_Z - 1}, -1, -1), lambda k: CAST(((x >> k) & 1) + 2 * ((y >> k) & 1) AS VARCHAR)), '') AS quadkey FROM k"""
)
def geojson_quadkey(spark, d):
    """The quadkey of the deepest tile, down to a zoom, that holds a GeoJSON point."""
    g = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    b = fx.spread(fx.transects(spark, d)).select("id", lines.geojson_bbox(g).alias("b"))
    return b.select("id", tl.bounding_quadkey(F.col("b")[0], F.col("b")[1], F.col("b")[2], F.col("b")[3], _Z).alias("quadkey"))


@query(f"{_T}, w AS (SELECT id, lon - 5e0 AS a, lon + 5e0 AS b FROM transects) SELECT id, CAST(k AS INT) AS k, {q('CASE WHEN k = 0 THEN greatest(a, -18e1) WHEN a < -18e1 THEN a + 36e1 ELSE -18e1 END')} AS xmin, {q('CASE WHEN k = 0 THEN least(b, 18e1) WHEN a < -18e1 THEN 18e1 ELSE b - 36e1 END')} AS xmax FROM w, unnest(range(CASE WHEN a < -18e1 OR b > 18e1 THEN 2 ELSE 1 END)) AS u(k)")
def antimeridian_boxes(spark, d):
    """Boxes that reach over the antimeridian as two."""
    b = lines.split_box(F.col("lon") - 5.0, F.col("lon") + 5.0)
    t = fx.transects(spark, d).select("id", F.posexplode(b).alias("k", "b"))
    return t.select("id", "k", r("b.xmin").alias("xmin"), r("b.xmax").alias("xmax"))
