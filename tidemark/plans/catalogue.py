"""Scans, projections, filters, and what a catalogue says of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import grids, scan
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

BOX = (-20.0, -10.0, 60.0, 45.0)
_EDGES = ("xmin", "ymin", "xmax", "ymax")
_OVERLAP = "xmin <= 6e1 AND ymin <= 45e0 AND xmax >= -2e1 AND ymax >= -1e1"


@query(f"{with_views('transects')} SELECT id, transect_id, country, {q('rate')} AS rate FROM transects WHERE {_OVERLAP}")
def bbox_overlap_scan(spark, d):
    return fx.transects(spark, d).where(scan.overlaps(BOX, *_EDGES)).select("id", "transect_id", "country", r("rate").alias("rate"))


@query(f"{with_views('transects')} SELECT id, lon, lat FROM transects WHERE xmin > -2e1 AND ymin > -1e1 AND xmax < 6e1 AND ymax < 45e0")
def bbox_within_scan(spark, d):
    return fx.transects(spark, d).where(scan.within(BOX, *_EDGES)).select("id", "lon", "lat")


@query(f"{with_views('transects')} SELECT count(*) AS n, {q('avg(rate)', 9)} AS mean_rate FROM transects WHERE lon BETWEEN -2e1 AND 6e1 AND lat BETWEEN -1e1 AND 45e0")
def point_in_bbox(spark, d):
    return fx.transects(spark, d).where(scan.point_in(BOX, "lon", "lat")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("rate"), 9).alias("mean_rate"))


@query(
    f"""{with_views('transects', 'items')}, hit AS (SELECT * FROM items WHERE {_OVERLAP})
SELECT h.href, count(*) AS n, {q('avg(rate)', 9)} AS mean_rate FROM transects t JOIN hit h ON t.lon >= h.xmin AND t.lon < h.xmax WHERE t.xmin <= 6e1 AND t.ymin <= 45e0 AND t.xmax >= -2e1 AND t.ymax >= -1e1 GROUP BY h.href"""
)
def pruned_fetch_by_catalog(spark, d):
    """Files by footprint first, then rows of these by bounds; the slab of a longitude is computed, so nothing but the join on the file remains."""
    files = scan.matching_files(fx.items(spark, d), spark.createDataFrame([BOX], "xmin double, ymin double, xmax double, ymax double"))
    rows = fx.transects(spark, d).where(scan.overlaps(BOX, *_EDGES))
    named = fx.items(spark, d).join(files, "href", "left_semi").select("href", F.col("xmin").alias("x0"), F.col("xmax").alias("x1"), F.col("item_id"))
    # float edges: the slab by division, or one of its neighbours
    slab = F.floor((F.col("lon") + 180.0) / 14.4)
    rows = rows.withColumn("item_id", F.explode(F.array(slab - 1, slab, slab + 1)))
    hit = rows.join(named, "item_id").where((F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1")))
    return hit.groupBy("href").agg(F.count(F.lit(1)).alias("n"), r(F.avg("rate"), 9).alias("mean_rate"))


@query(
    f"""{with_views('transects')} SELECT shore_type, coastal_type, count(*) AS n, {q('avg(rate)', 9)} AS mean_rate FROM transects WHERE {_OVERLAP} GROUP BY shore_type, coastal_type ORDER BY mean_rate, shore_type, coastal_type"""
)
def mean_rate_by_class(spark, d):
    """The flagship: in a bounding box, the mean rate of change by class."""
    t = fx.transects(spark, d).where(scan.overlaps(BOX, *_EDGES)).where("shore_type is not null and coastal_type is not null")
    return t.groupBy("shore_type", "coastal_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("rate"), 9).alias("mean_rate")).orderBy("mean_rate", "shore_type", "coastal_type")


@query("SELECT url, CASE WHEN url LIKE 'https://%' THEN url || (CASE WHEN contains(url, '?') THEN '&' ELSE '?' END) || 'sv=1' END AS signed FROM pages")
def sign_href(spark, d):
    from tidemark.functions.names import signed

    return fx.table(spark, d, "pages").select("url", signed("url", token="sv=1").alias("signed"))


@query(f"{with_views('transects')} SELECT min(xmin) AS minx, min(ymin) AS miny, max(xmax) AS maxx, max(ymax) AS maxy, count(*) AS n FROM transects")
def dataset_bounds(spark, d):
    t = fx.transects(spark, d)
    return t.agg(F.min("xmin").alias("minx"), F.min("ymin").alias("miny"), F.max("xmax").alias("maxx"), F.max("ymax").alias("maxy"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS row_count, min(ts) AS start_datetime, max(ts) AS end_datetime, count(DISTINCT user_id) AS users FROM events")
def catalog_item_stats(spark, d):
    return fx.table(spark, d, "events").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("start_datetime"), F.max("ts").alias("end_datetime"), F.count_distinct("user_id").alias("users"))


@query(f"{with_views('transects')} SELECT country, count(*) AS n, {q('min(rate)', 9)} AS min, {q('quantile_cont(rate, 25e-2)', 9)} AS q25, {q('median(rate)', 9)} AS q50, {q('quantile_cont(rate, 75e-2)', 9)} AS q75, {q('max(rate)', 9)} AS max, {q('avg(rate)', 9)} AS mean, {q('stddev_samp(rate)', 9)} AS std FROM transects GROUP BY country")
def describe_by_group(spark, d):
    out = grids.describe(fx.transects(spark, d), "rate", ["country"])
    return out.select("country", "n", *[r(c, 9).alias(c) for c in ("min", "q25", "q50", "q75", "max", "mean", "std")])


@query(f"{with_views('transects')}, p AS (SELECT quantile_cont(rate, 25e-3) AS a, quantile_cont(rate, 975e-3) AS b FROM transects) SELECT {q('a', 9)} AS low, {q('b', 9)} AS high, {q('least(15, greatest(abs(a), abs(b)))', 9)} AS symmetric_limit FROM p")
def rate_quantile_limits(spark, d):
    p = fx.transects(spark, d).agg(F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    a, b = F.col("p")[0], F.col("p")[1]
    return p.select(r(a, 9).alias("low"), r(b, 9).alias("high"), r(F.least(F.lit(15.0), F.greatest(F.abs(a), F.abs(b))), 9).alias("symmetric_limit"))


@query(f"{with_views('transects')} SELECT continent, {q('100e0 * count(*) FILTER (WHERE rate < 0) / count(rate)')} AS percent, count(rate) AS n FROM transects GROUP BY continent")
def pct_below_threshold_group(spark, d):
    return grids.percent_below(fx.transects(spark, d), "rate", 0.0, ["continent"]).select("continent", r("percent").alias("percent"), "n")


@query(f"{with_views('series')} SELECT {q('100e0 * count(*) FILTER (WHERE chainage < 5) / count(chainage)')} AS percent, count(chainage) AS n FROM series")
def pct_below_threshold_global(spark, d):
    return grids.percent_below(fx.series(spark, d), "chainage", 5.0).select(r("percent").alias("percent"), "n")


@query(f"{with_views('stac_items')} SELECT id, datetime, cloud_cover FROM stac_items WHERE cloud_cover <= 10 AND datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def search_items(spark, d):
    start, end = (F.to_timestamp(F.lit(x)) for x in ("1996-01-01", "1996-12-31"))
    return fx.stac_items(spark, d).where((F.col("cloud_cover") <= 10) & F.col("datetime").between(start, end)).select("id", "datetime", "cloud_cover")
