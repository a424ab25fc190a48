"""Pixel queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import raster as R
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

_P = with_views("pixels")
_ID = "cube_id, y, x"


@query(f"{_P} SELECT {_ID}, red IS NULL OR isnan(red) OR isinf(red) OR SCL = 0 AS mask FROM pixels")
def nodata_mask(spark, d):
    return fx.pixels(spark, d).select("cube_id", "y", "x", (R.nodata_mask("red") | R.nodata_mask("SCL", 0)).alias("mask"))


@query(f"{_P} SELECT {_ID}, SCL IN (5, 7) AS mask FROM pixels")
def numeric_mask(spark, d):
    return fx.pixels(spark, d).select("cube_id", "y", "x", R.numeric_mask("SCL", [5, 7]).alias("mask"))


@query(f"{_P} SELECT {_ID}, SCL IN (4, 11) AS mask FROM pixels")
def scl_mask(spark, d):
    return fx.pixels(spark, d).select("cube_id", "y", "x", R.scene_mask(["Vegetation", 11]).alias("mask"))


@query(f"{_P} SELECT {_ID}, {q('CASE WHEN SCL NOT IN (3, 8, 9, 10) THEN red END')} AS red FROM pixels")
def apply_mask(spark, d):
    clouds = R.scene_mask(["cloud shadows", "cloud medium probability", "cloud high probability", "thin cirrus"])
    return fx.pixels(spark, d).select("cube_id", "y", "x", r(R.masked("red", clouds)).alias("red"))


@query(f"{_P} SELECT {_ID}, CAST(coalesce(CASE WHEN SCL <> 0 THEN round_even(red * 10000, 0) END, -9999) AS SMALLINT) AS red FROM pixels")
def scale_int16(spark, d):
    p = fx.pixels(spark, d).withColumn("red", R.masked("red", F.col("SCL") == 0))
    return p.select("cube_id", "y", "x", R.scaled("red", 10000, nodata=-9999).alias("red"))


@query(f"{_P} SELECT {_ID}, {q('CASE WHEN SCL <> 4 THEN SCL * 1e-1 + 2e0 END')} AS value FROM pixels")
def unscale(spark, d):
    return fx.pixels(spark, d).select("cube_id", "y", "x", r(R.unscaled("SCL", 0.1, 2.0, nodata=4)).alias("value"))


def _sql(formula: str) -> str:
    return re.sub(r"(\d)D\b", r"\1e0", formula).replace("greatest(", "greatest(")


for _n in R.INDICES:

    @query(f"{_P} SELECT {_ID}, {q(_sql(R.INDICES[_n]), 5)} AS value FROM pixels", name=f"index_{_n.lower()}")
    def _index(spark, d, n=_n):
        return R.with_indices(fx.pixels(spark, d), n, normalize=False).select("cube_id", "y", "x", r(F.col(n), 5).alias("value"))


@query(f"{_P} SELECT {_ID}, {q('least(1, greatest(0, (red * 1000 - 800) / (12500e0 - 800)))')} AS min_max, {q('least(1, greatest(0, (red * 1000 - 1000) / (5000e0 - 1000)))')} AS robust, {q('(red * 1000 - 1660) / 710e0')} AS standard FROM pixels")
def scalers(spark, d):
    p = fx.pixels(spark, d).withColumn("b", F.col("red") * 1000)
    s = R.band_statistics("red")
    return p.select("cube_id", "y", "x", *[r(R.scaler(k, "b", s)).alias(n) for k, n in (("min_max", "min_max"), ("robust_min_max", "robust"), ("standard", "standard"))])


@query(
    f"""{_P} SELECT {_ID}, {q('deltadtm - min(deltadtm) OVER (PARTITION BY cube_id)')} AS deltadtm_rel, CAST(0 AS SMALLINT) AS deltadtm_mask_nodata, CAST(SCL IN (1, 2, 3) AS SMALLINT) AS SCL_mask_roi, CAST(SCL = 2 AS SMALLINT) AS SCL_mask_landward, CAST(SCL = 3 AS SMALLINT) AS SCL_mask_seaward FROM pixels"""
)
def transforms(spark, d):
    t = R.with_transforms(fx.pixels(spark, d), {"relative": "deltadtm", "nodata_mask": "deltadtm", "roi_mask": "SCL", "landward_mask": "SCL", "seaward_mask": "SCL"}, merge=False)
    return t.withColumn("deltadtm_rel", r("deltadtm_rel"))


@query(f"{_P} SELECT y, x, {q('median(red)')} AS red, {q('median(nir)')} AS nir FROM pixels GROUP BY y, x")
def median_composite(spark, d):
    return R.composite_median(fx.pixels(spark, d), ["red", "nir"]).select("y", "x", r("red").alias("red"), r("nir").alias("nir"))


@query(f"{_P} SELECT y, x, {q('quantile_cont(red, 2e-1)')} AS red FROM pixels GROUP BY y, x")
def percentile_composite(spark, d):
    return R.composite_percentile(fx.pixels(spark, d), ["red"], 20).select("y", "x", r("red").alias("red"))


@query(
    f"""{with_views('stac_items')} SELECT tile, min(datetime) AS start_datetime, max(datetime) AS end_datetime, {q('(epoch_us(max(datetime)) - epoch_us(min(datetime))) / 86400000000e0 / nullif(count(*) - 1, 0)')} AS mean_gap_days, count(*) AS n_obs, CAST(floor(avg(cloud_cover)) AS BIGINT) AS cloud_cover FROM stac_items GROUP BY tile"""
)
def composite_metadata(spark, d):
    m = R.composite_metadata(fx.stac_items(spark, d), ["tile"])
    return m.select("tile", "start_datetime", "end_datetime", r("mean_gap_days").alias("mean_gap_days"), "n_obs", "cloud_cover")


@query(f"{_P} SELECT cube_id, {q('100e0 * count(*) FILTER (WHERE SCL = 6) / nullif(count(*) FILTER (WHERE SCL <> 0), 0)')} AS percent FROM pixels GROUP BY cube_id")
def water_occurrence(spark, d):
    return fx.pixels(spark, d).groupBy("cube_id").agg(r(F.try_divide(F.count_if(F.col("SCL") == 6) * 100.0, F.nullif(F.count_if(F.col("SCL") != 0), F.lit(0)))).alias("percent"))


@query(f"{_P} SELECT y, x, CAST(coalesce(round_even(100e0 * avg(CAST(SCL = 6 AS INT)) FILTER (WHERE SCL <> 0), 0), 255) AS INT) AS probability FROM pixels GROUP BY y, x")
def water_probability(spark, d):
    valid = F.when(F.col("SCL") != 0, (F.col("SCL") == 6).cast("int"))
    return fx.pixels(spark, d).groupBy("y", "x").agg(F.coalesce(F.bround(F.avg(valid) * 100).cast("int"), F.lit(255)).alias("probability"))


@query(
    f"""{_P}, v AS (SELECT *, CASE WHEN y >= 2 AND x >= 1 AND x <= 6 THEN red END AS b FROM pixels),
e AS (SELECT cube_id, min(y) FILTER (WHERE b IS NOT NULL) AS y0, max(y) FILTER (WHERE b IS NOT NULL) AS y1, min(x) FILTER (WHERE b IS NOT NULL) AS x0, max(x) FILTER (WHERE b IS NOT NULL) AS x1 FROM v GROUP BY cube_id)
SELECT v.cube_id, y - y0 AS y, x - x0 AS x, {q('b')} AS b FROM v JOIN e ON v.cube_id = e.cube_id WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"""
)
def trim_outer_nan(spark, d):
    p = fx.pixels(spark, d).withColumn("b", F.when((F.col("y") >= 2) & F.col("x").between(1, 6), F.col("red")))
    return R.trim(p.select("cube_id", "y", "x", "b"), "b").select("cube_id", "y", "x", r("b").alias("b"))


@query(f"{_P} SELECT y, x, {q('coalesce(max(CASE WHEN cube_id = 0 AND SCL > 4 THEN red END), max(CASE WHEN cube_id = 1 AND SCL > 4 THEN red END), max(CASE WHEN cube_id = 2 THEN red END))')} AS red FROM pixels WHERE cube_id IN (0, 1, 2) GROUP BY y, x")
def combine_first(spark, d):
    p = fx.pixels(spark, d)
    part = lambda k, least: p.where(F.col("cube_id") == k).select("y", "x", F.when(F.col("SCL") > least, F.col("red")).alias("red"))
    return R.combine_first([part(0, 4), part(1, 4), part(2, -1)], ["red"]).select("y", "x", r("red").alias("red"))


@query(f"{_P} SELECT {_ID}, band, {q('value')} AS value FROM (UNPIVOT (SELECT cube_id, y, x, red, nir FROM pixels) ON red, nir INTO NAME band VALUE value)")
def band_unpivot(spark, d):
    return fx.pixels(spark, d).unpivot(["cube_id", "y", "x"], ["red", "nir"], "band", "value").withColumn("value", r("value"))


@query(f"{_P} SELECT cube_id, {q('avg(red) FILTER (WHERE SCL = 4)')} AS c4, {q('avg(red) FILTER (WHERE SCL = 5)')} AS c5, {q('avg(red) FILTER (WHERE SCL = 6)')} AS c6 FROM pixels GROUP BY cube_id")
def band_pivot(spark, d):
    p = fx.pixels(spark, d).groupBy("cube_id").pivot("SCL", [4, 5, 6]).agg(F.avg("red"))
    return p.select("cube_id", *[r(F.col(f"`{k}`")).alias(f"c{k}") for k in (4, 5, 6)])


@query(
    f"""{_P}, e AS (SELECT cube_id, min(nir) AS lo, max(nir) AS hi FROM pixels GROUP BY cube_id),
h AS (SELECT cube_id, lo, hi, CASE WHEN hi > lo THEN least(255, CAST(floor((nir - lo) / ((hi - lo) / 256)) AS BIGINT)) ELSE 0 END AS bin, count(*) AS n FROM pixels JOIN e USING (cube_id) GROUP BY ALL),
m AS (SELECT *, lo + (bin + 5e-1) * (hi - lo) / 256 AS mid FROM h),
c AS (SELECT *, sum(n) OVER o AS w, sum(n * mid) OVER o AS s, sum(n) OVER (PARTITION BY cube_id) AS tw, sum(n * mid) OVER (PARTITION BY cube_id) AS ts FROM m WINDOW o AS (PARTITION BY cube_id ORDER BY bin)),
b AS (SELECT *, row_number() OVER (PARTITION BY cube_id ORDER BY w * (tw - w) * power(s / w - (ts - s) / nullif(tw - w, 0), 2) DESC NULLS LAST, bin) AS k FROM c)
SELECT cube_id, {q('mid')} AS threshold, CAST(tw AS BIGINT) AS n FROM b WHERE k = 1"""
)
def otsu_threshold(spark, d):
    return R.otsu(fx.pixels(spark, d), "nir", ["cube_id"]).select("cube_id", r("threshold").alias("threshold"), "n")


@query(
    f"""{_P}, m AS (SELECT y, x, median(red) AS red, median(nir) AS nir FROM pixels WHERE SCL NOT IN (8, 9) GROUP BY y, x)
SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(round_even(red * 10000, 0) AS SMALLINT) AS red, CAST(round_even((nir - red) / (nir + red) * 10000, 0) AS SMALLINT) AS NDVI FROM m"""
)
def cube_pipeline(spark, d):
    """The fluent builder from search to storage; the search box is the globe, which covers every footprint."""
    from tidemark.operators.cubes import RasterCube

    p = fx.pixels(spark, d)
    lon, lat = (F.col("cube_id") * 37) % 3600 / 10.0 - 180.0, (F.col("cube_id") * 53) % 1600 / 10.0 - 80.0
    items = p.select("cube_id").distinct().select("cube_id", lon.alias("xmin"), lat.alias("ymin"), (lon + 0.1).alias("xmax"), (lat + 0.1).alias("ymax"), F.col("cube_id").alias("id"))
    cube = RasterCube(items, p, ("red", "nir"), item_key="cube_id").search((-180.0, -90.0, 180.0, 90.0)).load(["red", "nir"])
    cube = cube.mask_and_scale(mask_scene=["cloud medium probability", "cloud high probability"]).composite("median").add_spectral_indices(["NDVI"]).optimize_for_storage(10000, -9999)
    return cube.execute().select("y", "x", "red", "NDVI")


@query()
def chip_contours(spark, d):
    """Sub-pixel lines of chips at the level 0.9, as number of lines and vertices."""
    import pandas as pd

    from tidemark.functions.chips import contours
    from tidemark.operators.cubes import on_chips

    def kernel(key, chip):
        found = contours(chip, 0.9)
        return pd.DataFrame({"cube_id": [key[0]], "n_lines": [len(found)], "n_vertices": [sum(map(len, found))]})

    return on_chips(fx.pixels(spark, d), "nir", kernel, "cube_id long, n_lines long, n_vertices long")


@query()
def chip_resample(spark, d):
    """Chips turned by 30 degrees and resampled to 4 x 4: mean of what is left."""
    import numpy as np
    import pandas as pd

    from tidemark.functions.chips import resize, rotate
    from tidemark.operators.cubes import on_chips

    def kernel(key, chip):
        return pd.DataFrame({"cube_id": [key[0]], "mean": [round(float(np.nanmean(resize(rotate(chip, 30.0), 4, 4))), 6)]})

    return on_chips(fx.pixels(spark, d), "nir", kernel, "cube_id long, mean double")
