"""Grid tables: admin filters, tiles, priorities, hotspots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import grids as G
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

_G = with_views("grid")


@query(f"{_G} SELECT grid_id FROM grid WHERE list_has_any(continents, ['EU', 'AS', 'NA']) AND len(list_filter(countries, lambda c: NOT list_contains(['RU', 'US'], c))) > 0")
def admin_include_exclude(spark, d):
    return G.filter_by_admins(fx.grid(spark, d), include_continents=["EU", "AS", "NA"], exclude_countries=["RU", "US"]).select("grid_id")


@query(f"{_G}, e AS (SELECT grid_id, unnest(coalesce(mgrs_tiles, [NULL])) AS mgrs_tile FROM grid) SELECT grid_id, mgrs_tile, concat_ws('_', mgrs_tile, grid_id) AS tile_id FROM e")
def grid_explode_mgrs(spark, d):
    return G.by_mgrs_tile(fx.grid(spark, d)).select("grid_id", "mgrs_tile", "tile_id")


@query(f"{_G}, e AS (SELECT grid_id, unnest(mgrs_tiles) AS mgrs_tile FROM grid), n AS (SELECT *, row_number() OVER (PARTITION BY mgrs_tile ORDER BY grid_id) - 1 AS k FROM e) SELECT grid_id, mgrs_tile || '-' || (CASE WHEN k < 10 THEN '0' ELSE '' END) || k AS tile_id FROM n")
def tile_id_suffix(spark, d):
    return G.with_tile_numbers(fx.grid(spark, d).select("grid_id", F.explode("mgrs_tiles").alias("mgrs_tile"))).select("grid_id", "tile_id")


@query(
    f"""{_G}, f AS (SELECT *, list_contains(continents, 'EU') AS eu, list_contains(countries, 'RU') AS ru, list_has_any(countries, ['NO', 'SE']) AS n, ymin <= 70 AND ymax >= -70 AS mid FROM grid)
SELECT grid_id, CAST(CASE WHEN eu AND NOT ru AND NOT n THEN 10 WHEN eu AND NOT ru THEN 9 WHEN eu AND mid THEN 8 WHEN NOT eu AND mid THEN 7 ELSE 6 END AS INT) AS priority FROM f"""
)
def priorities(spark, d):
    return fx.grid(spark, d).select("grid_id", G.priority().alias("priority"))


_CELLS = "cells AS (SELECT CAST(floor((lon + 180) / 10) AS BIGINT) AS x, CAST(floor((lat + 80) / 10) AS BIGINT) AS y, avg(rate) AS value FROM transects GROUP BY 1, 2)"


@query(
    f"""{with_views('transects')}, {_CELLS}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM cells), z AS (SELECT x, y, (value - m) / sd AS z FROM cells, s),
l AS (SELECT a.x, a.y, any_value(a.z) AS z, avg(b.z) AS lag, count(b.z) AS n FROM z a LEFT JOIN z b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.x, a.y)
SELECT x, y, {q('z * lag', 5)} AS moran_i, CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z > 0 AND lag < 0 THEN 'HL' WHEN z < 0 AND lag > 0 THEN 'LH' END AS quadrant FROM l"""
)
def moran_local(spark, d):
    t = fx.transects(spark, d)
    cells = t.groupBy(F.floor((F.col("lon") + 180) / 10).alias("x"), F.floor((F.col("lat") + 80) / 10).alias("y")).agg(F.avg("rate").alias("value"))
    return G.local_moran(cells).select("x", "y", r("moran_i", 5).alias("moran_i"), "quadrant")


@query(f"{with_views('transects')} SELECT id, {q('rate')} AS rate FROM transects ORDER BY rate DESC, id LIMIT (SELECT CAST(floor(count(*) * 25e-3) AS BIGINT) FROM transects)")
def hotspots(spark, d):
    """The highest 2.5 % by rate."""
    return G.top_share(fx.transects(spark, d), "rate", 0.025, "id").select("id", r("rate").alias("rate"))


@query(f"{with_views('transects')} SELECT country, to_json(list_sort(list(DISTINCT shore_type))) AS shore_types, count(DISTINCT coastal_type) AS n_types FROM transects GROUP BY country")
def attribute_lists(spark, d):
    return fx.transects(spark, d).groupBy("country").agg(F.to_json(F.array_sort(F.collect_set("shore_type"))).alias("shore_types"), F.count_distinct("coastal_type").alias("n_types"))


@query(
    f"""{_G}, f AS (SELECT grid_id, ymin, ymax, unnest(mgrs_tiles) AS tile FROM grid WHERE list_has_any(continents, ['EU', 'AS', 'NA']))
SELECT tile AS mgrs_tile, {q('min(ymin)')} AS ymin, {q('max(ymax)')} AS ymax, count(*) AS n, CAST((CASE WHEN substr(tile, 3, 1) >= 'N' THEN 32600 ELSE 32700 END) + CAST(substr(tile, 1, 2) AS INT) AS INT) AS utm_epsg FROM f GROUP BY tile"""
)
def mgrs_grid(spark, d):
    """Grid cells filtered, dealt to tiles and taken together by tile, with the zone's EPSG code."""
    g = G.by_mgrs_tile(G.filter_by_admins(fx.grid(spark, d), include_continents=["EU", "AS", "NA"])).where("mgrs_tile is not null")
    return g.groupBy("mgrs_tile").agg(r(F.min("ymin")).alias("ymin"), r(F.max("ymax")).alias("ymax"), F.count(F.lit(1)).alias("n"), F.min("utm_epsg").cast("int").alias("utm_epsg"))


@query(
    """WITH areas AS (SELECT s_suppkey AS area_id, (s_suppkey * 71) % 3500 / 1e1 - 18e1 AS xmin, (s_suppkey * 29) % 1500 / 1e1 - 8e1 AS ymin, (s_suppkey * 71) % 3500 / 1e1 - 18e1 + 6 AS xmax, (s_suppkey * 29) % 1500 / 1e1 - 8e1 + 4 AS ymax FROM supplier WHERE s_suppkey % 13 <> 0),
tiles AS (SELECT 'z4x' || x || 'y' || y AS name, x / 16e0 * 36e1 - 18e1 AS x0, (x + 1) / 16e0 * 36e1 - 18e1 AS x1, degrees(atan(sinh(pi() * (1 - 2 * y / 16e0)))) AS y1, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 16e0)))) AS y0 FROM range(16) AS a(x), range(16) AS b(y))
SELECT name, count(*) AS n, CAST((CASE WHEN y0 + y1 >= 0 THEN 32600 ELSE 32700 END) + CAST(floor(((x0 + x1) / 2 + 180) / 6) AS INT) % 60 + 1 AS INT) AS utm_epsg
FROM tiles JOIN areas ON x0 <= xmax AND xmin <= x1 AND y0 <= ymax AND ymin <= y1 GROUP BY name, x0, x1, y0, y1"""
)
def coastal_grid_build(spark, d):
    """Tiles that a coastal zone touches, with the number of its areas and the UTM zone of their middle."""
    from tidemark.functions import crs
    from tidemark.functions import tiles as tl
    from tidemark.operators import joins as J
    from tidemark.plans.joins import _areas

    tiles = tl.all_tiles(spark, 4).select("name", "xmin", "ymin", "xmax", "ymax")
    hit = J.box_join(_areas(spark, d).where("xmin is not null"), tiles, "area_id", "name", 10.0)
    hit = hit.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.min(f"b_{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return hit.select("name", "n", crs.utm_epsg((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2).cast("int").alias("utm_epsg"))
