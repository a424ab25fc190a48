"""Planar geometry, reference systems and transects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import crs, planar
from tidemark.functions.planar import point
from tidemark.operators import series as ops
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

#: A pair of planar points for each transect.
_PAIRS = "pairs AS (SELECT id, lon AS ax, lat AS ay, lon + (id % 7) - 3e0 AS bx, lat + (id % 5) - 2e0 AS cy FROM transects)"
_DIST = "sqrt((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay))"


def _pairs(spark, d):
    t = fx.transects(spark, d)
    return t.select("id", point("lon", "lat").alias("a"), point(F.col("lon") + (F.col("id") % 7) - 3.0, F.col("lat") + (F.col("id") % 5) - 2.0).alias("b"))



def _ab():
    return F.col("a"), F.col("b")


_BEARING = "fmod(fmod(9e1 - degrees(atan2(cy - ay, bx - ax)), 36e1) + 36e1, 36e1)"


@query(f"{with_views('transects')}, {_PAIRS} SELECT id, {q('degrees(atan2(cy - ay, bx - ax))')} AS angle, {q(_BEARING)} AS bearing, {q(_DIST)} AS distance FROM pairs WHERE ax <> bx OR ay <> cy")
def planar_bearing(spark, d):
    a, b = _ab()
    p = _pairs(spark, d).where(a != b)
    return p.select("id", r(planar.angle(a, b)).alias("angle"), r(planar.bearing(a, b)).alias("bearing"), r(planar.distance(a, b)).alias("distance"))


def _rotation(name: str, cases: str):
    @query(
        f"{with_views('transects')}, {_PAIRS}, t AS (SELECT *, {_BEARING} AS t FROM pairs WHERE ax <> bx OR ay <> cy) SELECT id, CASE WHEN ax = bx OR ay = cy THEN 0e0 ELSE {q(f'CASE {cases} END')} END AS rotation FROM t",
        name=f"rotation_angle_{name.split('-')[0] if name != 'horizontal-right-aligned' else 'right'}",
    )
    def run(spark, d):
        a, b = _ab()
        return _pairs(spark, d).where(a != b).select("id", r(planar.rotation_angle(a, b, name)).alias("rotation"))


_rotation("closest", "WHEN t % 90 < 45 THEN t % 90 ELSE t % 90 - 90")
_rotation("vertical", "WHEN t < 180 THEN t WHEN t < 270 THEN t - 270 ELSE t - 360")
_rotation("horizontal", "WHEN t < 90 THEN t - 90 WHEN t < 180 THEN t - 90 WHEN t < 270 THEN t - 270 ELSE t - 270")
_rotation("horizontal-right-aligned", "WHEN t < 90 THEN t + 90 WHEN t < 270 THEN t - 270 ELSE t - 270")


@query(f"{with_views('transects')}, {_PAIRS}, s AS (SELECT *, least(1e0, 15e-1 / {_DIST}) AS s FROM pairs WHERE ax <> bx OR ay <> cy) SELECT id, {q('ax + (bx - ax) * s')} AS x, {q('ay + (cy - ay) * s')} AS y FROM s")
def shift_point(spark, d):
    a, b = _ab()
    p = _pairs(spark, d).where(a != b).select("id", planar.shift_point(a, b, 1.5).alias("p"))
    return p.select("id", r("p.x").alias("x"), r("p.y").alias("y"))


@query(
    f"""{with_views('transects')}, {_PAIRS}, s AS (SELECT *, (2e1 - {_DIST}) / 2 / {_DIST} AS s FROM pairs WHERE ax <> bx OR ay <> cy)
SELECT id, {q('ax - (bx - ax) * s')} AS x0, {q('ay - (cy - ay) * s')} AS y0, {q('bx + (bx - ax) * s')} AS x1, {q('cy + (cy - ay) * s')} AS y1 FROM s"""
)
def extend_transect(spark, d):
    a, b = _ab()
    p = _pairs(spark, d).where(a != b).select("id", planar.extend_transect(F.array(a, b), 20.0).alias("l"))
    f, z = planar.first("l"), planar.last("l")
    return p.select("id", r(f["x"]).alias("x0"), r(f["y"]).alias("y0"), r(z["x"]).alias("x1"), r(z["y"]).alias("y1"))


@query(
    f"""{with_views('transects')}, {_PAIRS} SELECT id, {q(f'2 * 5e-1 * {_DIST}')} AS area, {q(f'ax - (cy - ay) / {_DIST} * 5e-1')} AS x0, {q(f'ay + (bx - ax) / {_DIST} * 5e-1')} AS y0, 5 AS n FROM pairs WHERE ax <> bx OR ay <> cy"""
)
def offset_rectangle(spark, d):
    a, b = _ab()
    p = _pairs(spark, d).where(a != b).select("id", planar.offset_rectangle(a, b, 0.5).alias("ring"))
    f = planar.first("ring")
    return p.select("id", r(planar.area("ring")).alias("area"), r(f["x"]).alias("x0"), r(f["y"]).alias("y0"), F.size("ring").alias("n"))


_SEG = "list_sum(list_transform(range(1, len(line)), lambda k: sqrt(power(line[k + 1].x - line[k].x, 2) + power(line[k + 1].y - line[k].y, 2))))"
_CHORD = "sqrt(power(line[-1].x - line[1].x, 2) + power(line[-1].y - line[1].y, 2))"
_DIAG = "sqrt(power(list_max(list_transform(line, lambda p: p.x)) - list_min(list_transform(line, lambda p: p.x)), 2) + power(list_max(list_transform(line, lambda p: p.y)) - list_min(list_transform(line, lambda p: p.y)), 2))"


@query(
    f"""{with_views('lines')} SELECT country, {q(_SEG)} AS length, {q(f'{_SEG} / nullif({_CHORD}, 0)')} AS sinuosity, {q(f'ln({_SEG}) / ln({_DIAG})')} AS fractal_dimension,
  len(list_filter(range(1, len(line)), lambda k: abs(line[k + 1].x - line[k].x) > 180)) > 0 AS crosses_antimeridian, line[1] = line[-1] AS closed FROM lines WHERE len(line) > 1"""
)
def line_shapes(spark, d):
    """Length, sinuosity, fractal dimension and antimeridian flag of lines."""
    t = fx.lines(spark, d).where(F.size("line") > 1)
    return t.select("country", r(planar.length("line")).alias("length"), r(planar.sinuosity("line")).alias("sinuosity"), r(planar.fractal_dimension("line")).alias("fractal_dimension"), planar.crosses_antimeridian("line").alias("crosses_antimeridian"), planar.is_closed("line").alias("closed"))


@query(
    f"""WITH p AS (SELECT p_partkey, p_retailprice AS len, CAST(floor(p_retailprice / 1e2) AS INT) AS whole FROM part),
n AS (SELECT *, whole - (CASE WHEN len - whole * 1e2 < 5e1 THEN 1 ELSE 0 END) AS n FROM p)
SELECT p_partkey, CAST(CASE WHEN n = 0 THEN 1 WHEN n < 0 THEN 0 ELSE n END AS INT) AS n_origins, {q('CASE WHEN n = 0 THEN len / 2 WHEN n > 0 THEN (len - n * 1e2) / 2 END')} AS first_origin FROM n"""
)
def transect_origins(spark, d):
    o = planar.transect_origins("p_retailprice", 100.0)
    t = fx.table(spark, d, "part").select("p_partkey", o.alias("o"))
    return t.select("p_partkey", F.size("o").alias("n_origins"), r(F.get("o", F.lit(0))).alias("first_origin"))


_ZONE = "CAST((CAST(floor((lon + 180) / 6) AS INT) % 60 + 60) % 60 + 1 AS INT)"


@query(f"{with_views('transects')} SELECT id, {_ZONE} AS zone, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + {_ZONE} AS INT) AS epsg FROM transects")
def utm_zone_from_lon(spark, d):
    return fx.transects(spark, d).select("id", crs.utm_zone("lon").alias("zone"), crs.utm_epsg("lon", "lat").cast("int").alias("epsg"))


@query(f"{with_views('grid')}, e AS (SELECT grid_id, unnest(mgrs_tiles) AS tile FROM grid) SELECT grid_id, tile, CAST((CASE WHEN substr(tile, 3, 1) >= 'N' THEN 32600 ELSE 32700 END) + CAST(substr(tile, 1, 2) AS INT) AS INT) AS epsg FROM e")
def utm_epsg_from_mgrs(spark, d):
    return fx.grid(spark, d).select("grid_id", F.explode("mgrs_tiles").alias("tile")).withColumn("epsg", crs.epsg_of_mgrs("tile").cast("int"))


@query(f"{with_views('transects')} SELECT id, {q('radians(lon) * 6378137e0', 3)} AS x, {q('ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137e0', 3)} AS y FROM transects")
def mercator_forward(spark, d):
    return fx.transects(spark, d).select("id", crs.mercator("lon", "lat").alias("p")).select("id", r("p.x", 3).alias("x"), r("p.y", 3).alias("y"))


def _lit(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


_E = _lit(crs.ECCENTRICITY)
_PHI = f"(atanh(sin(radians(lat))) - {_E} * atanh({_E} * sin(radians(lat))))"
_UTM = f"""z AS (SELECT id, lon, lat, {_ZONE} AS zone FROM transects),
m AS (SELECT *, radians(lon - (zone * 6 - 183)) AS away, {_PHI} AS c FROM z),
k AS (SELECT *, atan2(sinh(c), cos(away)) AS xi, atanh(sin(away) / cosh(c)) AS eta FROM m)"""
_NORTH = "xi + " + " + ".join(f"{_lit(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
_EAST = "eta + " + " + ".join(f"{_lit(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
_K = _lit(crs.SCALE * crs.RECTIFYING)


@query(f"{with_views('transects')}, {_UTM} SELECT id, {q(f'({_EAST}) * {_K} + 5e5', 3)} AS x, {q(f'({_NORTH}) * {_K} + (CASE WHEN lat < 0 THEN 1e7 ELSE 0e0 END)', 3)} AS y FROM k")
def utm_forward(spark, d):
    t = fx.transects(spark, d).withColumn("epsg", crs.utm_epsg("lon", "lat"))
    return t.select("id", crs.utm("lon", "lat", "epsg").alias("p")).select("id", r("p.x", 3).alias("x"), r("p.y", 3).alias("y"))


@query(f"{with_views('transects')} SELECT id, {q('lon')} AS lon, {q('lat')} AS lat FROM transects")
def utm_roundtrip(spark, d):
    t = fx.transects(spark, d).withColumn("epsg", crs.utm_epsg("lon", "lat")).withColumn("p", crs.utm("lon", "lat", "epsg"))
    t = t.select("id", crs.utm_inverse(F.col("p.x"), F.col("p.y"), F.col("epsg")).alias("g"))
    return t.select("id", r("g.x").alias("lon"), r("g.y").alias("lat"))


@query()
def generated_transects(spark, d):
    """Transects across coastlines laid out in a zone's metres."""
    n = fx.table(spark, d, "nation")
    k = F.col("n_nationkey").cast("double")
    line = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda s: point(F.lit(500000.0) + s * 130.0, F.lit(5000000.0) + k * 1000 + F.sin(s.cast("double")) * 90.0))
    coast = n.select(F.concat(F.lit("cl"), F.col("n_nationkey").cast("string")).alias("coast_id"), line.alias("line"), F.lit(32631).alias("utm_epsg"))
    t = ops.transects(coast, 2000.0, 100.0)
    return t.select("transect_id", "coast_id", r("lon").alias("lon"), r("lat").alias("lat"), r("bearing", 4).alias("bearing"))
