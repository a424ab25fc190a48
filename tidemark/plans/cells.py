"""Rasters: scaling back and forth, merged tiles, regions, elevations under lines, colours of classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import raster as R
from tidemark.operators import cells as C
from tidemark.operators import typology as T
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

_P = with_views("pixels")


@query(f"{_P} SELECT cube_id, y, x, {q('CAST(round_even(red * 10000, 0) AS SMALLINT) * 1e-4')} AS red FROM pixels")
def scale_roundtrip(spark, d):
    """To whole numbers and back: what storage loses."""
    p = fx.pixels(spark, d).select("cube_id", "y", "x", R.scaled("red", 10000.0, nodata=-9999).alias("s"))
    return p.select("cube_id", "y", "x", r(R.unscaled("s", 1e-4, nodata=-9999)).alias("red"))


@query(f"{_P}, t AS (SELECT cube_id // 3 AS tile, cube_id % 3 AS time, y, x, CASE WHEN SCL NOT IN (8, 9) THEN red END AS red, CASE WHEN SCL NOT IN (8, 9) THEN nir END AS nir FROM pixels) SELECT tile, y, x, {q('median(red)')} AS red, {q('median(nir)')} AS nir, min(time) AS first, max(time) AS last FROM t GROUP BY tile, y, x")
def tile_merge(spark, d):
    """Overlapping tiles as one: the median over time of what is not masked, with the first and last time."""
    mask = R.scene_mask([8, 9])
    p = fx.pixels(spark, d).select(F.floor(F.col("cube_id") / 3).alias("tile"), (F.col("cube_id") % 3).alias("time"), "y", "x", R.masked("red", mask).alias("red"), R.masked("nir", mask).alias("nir"))
    return C.merged_tiles(p, ["red", "nir"], ["tile", "y", "x"]).select("tile", "y", "x", r("red").alias("red"), r("nir").alias("nir"), "first", "last")


@query(f"{_P} SELECT cube_id, y, x, CAST(CASE WHEN y >= 5 THEN 3 WHEN x >= 4 THEN 2 WHEN x >= 2 THEN 1 ELSE 0 END AS INT) AS roi FROM pixels")
def region_classes(spark, d):
    """0 outside, 1 region, 2 land, 3 sea; sea goes before land, land before the region."""
    roi = C.region_class(F.col("x") >= 2, (F.col("x") >= 4), F.col("y") >= 5)
    return fx.pixels(spark, d).select("cube_id", "y", "x", roi.alias("roi"))


@query(f"{_P} SELECT cube_id, {q('(min(x) + max(x) + 1) / 2e0')} AS x, {q('(min(y) + max(y) + 1) / 2e0')} AS y FROM pixels GROUP BY cube_id")
def raster_centres(spark, d):
    c = C.centres(fx.pixels(spark, d), ["cube_id"])
    return c.select("cube_id", r("x").alias("x"), r("y").alias("y"))


@query(f"{_P} SELECT cube_id, count(*) AS n, {q('sum(red)')} AS red FROM pixels WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6 GROUP BY cube_id")
def window_of_bounds(spark, d):
    """The cells nearest to the corners of bounds, and all between them."""
    p = C.window(fx.pixels(spark, d), 1.2, 1.6, 5.4, 6.4)
    return p.groupBy("cube_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("red")).alias("red"))


@query(f"{_P} SELECT cube_id * 8 + x AS lng, cube_id * 8 + y AS lat, {q('deltadtm')} AS z FROM pixels WHERE SCL <> 0")
def elevation_table(spark, d):
    """A raster as rows of place and height, without missing cells."""
    p = fx.pixels(spark, d).select((F.col("cube_id") * 8 + F.col("x")).alias("lng"), (F.col("cube_id") * 8 + F.col("y")).alias("lat"), R.masked("deltadtm", R.numeric_mask("SCL", [0])).alias("z"))
    return p.where("z is not null").select("lng", "lat", r("z").alias("z"))


@query(
    f"""{_P}, l AS (SELECT n_nationkey AS line_id, CAST(n_nationkey % 8 AS INT) AS y, 1e0 + n_nationkey % 3 AS a, 5e0 + n_nationkey % 2 AS b FROM nation)
SELECT line_id, count(*) AS n, {q('avg(deltadtm)')} AS z FROM l JOIN pixels p ON p.cube_id = line_id AND p.y = l.y AND p.x >= floor(a) AND p.x <= floor(b) GROUP BY line_id"""
)
def elevation_under_lines(spark, d):
    """Cells that a line runs through, by an equi-join on chip and cell."""
    from tidemark.functions.planar import point

    k = F.col("n_nationkey")
    y = (k % 8).cast("double") + 0.5
    n = fx.table(spark, d, "nation").select(k.cast("long").alias("cube_id"), F.array(point(k % 3 + 1.0, y), point(k % 2 + 5.0, y)).alias("line"))
    p = fx.pixels(spark, d).select("cube_id", "y", "x", "deltadtm")
    return C.under_lines(n, p, ["cube_id"]).groupBy(F.col("cube_id").cast("int").alias("line_id")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("deltadtm")).alias("z"))


@query(f"{_P}, a AS (SELECT cube_id, y, x, red FROM pixels WHERE x < 6), b AS (SELECT cube_id, y, x, nir FROM pixels WHERE x >= 2) SELECT coalesce(a.cube_id, b.cube_id) AS cube_id, count(*) AS n, count(red) AS n_red, count(nir) AS n_nir FROM a FULL JOIN b ON a.cube_id = b.cube_id AND a.y = b.y AND a.x = b.x GROUP BY 1")
def aligned_merge(spark, d):
    """Two rasters on one grid as one, cells of either kept."""
    p = fx.pixels(spark, d)
    both = C.aligned(p.where("x < 6").select("cube_id", "y", "x", "red"), p.where("x >= 2").select("cube_id", "y", "x", "nir"), ["cube_id", "y", "x"])
    return both.groupBy("cube_id").agg(F.count(F.lit(1)).alias("n"), F.count("red").alias("n_red"), F.count("nir").alias("n_nir"))


@query(f"{_P} SELECT cube_id, y, x, CASE WHEN SCL IN (8, 9) THEN NULL WHEN nir - red > 3e-1 THEN 2 WHEN nir - red > 1e-1 THEN 1 ELSE 0 END AS class FROM pixels")
def pixel_classes(spark, d):
    """A class for each pixel by thresholds of a feature; masked pixels have none."""
    x = R.masked(F.col("nir") - F.col("red"), R.scene_mask([8, 9]))
    return fx.pixels(spark, d).select("cube_id", "y", "x", C.classified(x, (0.1, 0.3)).alias("class"))


@query(f"{with_views('transects')} SELECT id, ['#E24A33', '#1A9850', '#A9A9A9', '#FFD700', '#D45D9F', '#8B5A2B', '#DA70D6', '#1E90FF', '#4D4D4D'][CAST(id % 9 AS BIGINT) + 1] AS colour, CAST(id % 9 AS INT) AS code FROM transects")
def colour_map(spark, d):
    """Names of classes by code, encoded and looked up among their colours."""
    label = "class:coastal_type"
    names = F.array(*[F.lit(n.upper()) for n, _ in T.CLASSES[label]])
    t = fx.transects(spark, d).select("id", F.element_at(names, (F.col("id") % 9 + 1).cast("int")).alias("name"))
    t = t.withColumn("code", T.encoded("name", T.encoding(label)))
    colours = F.create_map(*[F.lit(x) for kv in T.code_colours(label).items() for x in kv])
    return t.select("id", F.try_element_at(colours, F.col("code")).alias("colour"), "code")


@query(f"{with_views('transects')}, o AS (SELECT DISTINCT CASE WHEN id % 9 < 4 THEN id % 9 END AS k FROM transects) SELECT CAST(k AS INT) AS code, ['cliffed_or_steep', 'moderately_sloped', 'bedrock_plain', 'sediment_plain'][k + 1] AS name, ['#E24A33', '#1A9850', '#A9A9A9', '#FFD700'][k + 1] AS colour FROM o WHERE k IS NOT NULL")
def observed_colours(spark, d):
    """Codes and colours of the classes that occur."""
    label = "class:coastal_type"
    names = F.array(*[F.lit(n) for n, _ in T.CLASSES[label][:4]])
    t = fx.transects(spark, d).select(F.when(F.col("id") % 9 < 4, F.element_at(names, (F.col("id") % 9 + 1).cast("int"))).alias(label))
    t = T.observed(t, [label]).select(F.col("value").alias("name"))
    colours = F.create_map(*[F.lit(x) for kv in T.colours(label).items() for x in kv])
    return t.select(T.encoded("name", T.encoding(label)).alias("code"), "name", F.try_element_at(colours, F.col("name")).alias("colour"))


_N = "n AS (SELECT cube_id, y, x, red, CASE WHEN cube_id % 2 = 0 THEN -9999 END AS nodata FROM pixels)"


@query(f"{_P}, {_N} SELECT cube_id, count(*) FILTER (WHERE nodata IS NOT NULL AND SCL = 3) AS masked FROM (SELECT p.cube_id, p.SCL, n.nodata FROM pixels p JOIN n ON p.cube_id = n.cube_id AND p.y = n.y AND p.x = n.x) GROUP BY cube_id")
def nodata_values(spark, d):
    """Each chip's nodata value (zero and missing ones are none) masks its cells."""
    p = fx.pixels(spark, d)
    p = p.withColumn("attribute", F.when(F.col("cube_id") % 2 == 0, -9999.0).otherwise(0.0)).withColumn("value", F.when(F.col("SCL") == 3, -9999.0).otherwise(F.col("red")))
    gone = C.is_nodata("value", C.nodata_of("attribute"))
    return p.groupBy("cube_id").agg(F.count_if(gone).alias("masked"))


@query(f"{with_views('stac_items', 'pixels')}, c AS (SELECT DISTINCT cube_id FROM pixels) SELECT cube_id, datetime, {q('cloud_cover')} AS cloud_cover FROM c JOIN stac_items ON id = cube_id + 1")
def item_times(spark, d):
    """Times and cloud cover of items on the chips made from them."""
    chips = fx.pixels(spark, d).select("cube_id", (F.col("cube_id") + 1).alias("id")).distinct()
    return C.with_item_metadata(chips, fx.stac_items(spark, d), "id", ["datetime", "cloud_cover"]).select("cube_id", "datetime", r("cloud_cover").alias("cloud_cover"))


@query("SELECT n_nationkey AS id, round(2e0 * (abs(cos(radians(n_nationkey * 1e1))) * 3 + abs(sin(radians(n_nationkey * 1e1))) * 2), 6) + 0e0 AS width, n_nationkey % 9 <> 0 AS rotated FROM nation")
def rotated_bounds(spark, d):
    """Bounds of rasters of 6 x 4 that an affine transform turns, from their corners; whether it turns them at all (by other than right angles)."""
    k = F.radians(F.col("n_nationkey") * 10.0)
    n = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.cos(k).alias("a"), (-F.sin(k)).alias("b"), F.sin(k).alias("d"), F.cos(k).alias("e"))
    box = C.affine_bounds(F.col("a"), F.col("b"), F.lit(0.0), F.col("d"), F.col("e"), F.lit(0.0), 6.0, 4.0)
    return n.withColumn("box", box).select("id", r(F.col("box.xmax") - F.col("box.xmin")).alias("width"), C.is_rotated(F.col("a"), F.col("b"), F.col("d"), F.col("e")).alias("rotated"))


@query(f"{_P} SELECT cube_id, y, x, {q('CASE WHEN SCL = 3 THEN 0e0 ELSE deltadtm END')} AS z FROM pixels")
def terrain_without_gaps(spark, d):
    """Heights with zero for what is nodata, as the terrain product is made ready."""
    z = F.when(F.col("SCL") == 3, -9999.0).otherwise(F.col("deltadtm"))
    return fx.pixels(spark, d).select("cube_id", "y", "x", r(F.when(R.nodata_mask(z, -9999.0), 0.0).otherwise(z)).alias("z"))


@query(f"{_P} SELECT DISTINCT cube_id, TIMESTAMP '2020-01-01' AS time, TIMESTAMP '2020-12-31' AS end_time FROM pixels")
def static_times(spark, d):
    """A cube without time gets one step; a cube with more is an error."""
    c = C.with_static_time(fx.pixels(spark, d), "2020-01-01", "2020-12-31")
    return c.select("cube_id", "time", "end_time").distinct()


@query(f"{_P} SELECT cube_id, y, x, {', '.join(f'CAST(floor(255 * greatest(0e0, least(1e0, {b} / 15e-1)) + 5e-1) AS INT) AS {b}' for b in ('red', 'green', 'blue'))} FROM pixels")
def rgb_preview(spark, d):
    """Bands as bytes between a lower and an upper bound."""
    return fx.pixels(spark, d).select("cube_id", "y", "x", *[C.as_byte(b, 0.0, 1.5).alias(b) for b in ("red", "green", "blue")])
