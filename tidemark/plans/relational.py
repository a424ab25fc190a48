"""Filters, joins, windows and sets over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import grids, intervals, scan
from tidemark.operators import worklog as L
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

_T = with_views("transects")
_G = with_views("grid")


@query(f"{_T} SELECT id, country FROM transects WHERE shore_type IN ('BUILDING', 'MACHINERY')")
def isin_filter(spark, d):
    return fx.transects(spark, d).where(F.col("shore_type").isin("BUILDING", "MACHINERY")).select("id", "country")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_filter(spark, d):
    late = fx.table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    c = fx.table(spark, d, "customer")
    return c.join(late, c.c_custkey == late.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_filter(spark, d):
    big = fx.table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    c = fx.table(spark, d, "customer")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").select("c_custkey")


@query(f"{_G} SELECT 'with' AS part, count(*) AS n FROM grid WHERE mgrs_tiles IS NOT NULL UNION ALL SELECT 'without', count(*) FROM grid WHERE mgrs_tiles IS NULL")
def null_split(spark, d):
    """Rows with and without tiles, counted after they are put together again."""
    g = fx.grid(spark, d)
    here, gone = g.where("mgrs_tiles is not null"), g.where("mgrs_tiles is null")
    both = here.select(F.lit("with").alias("part")).unionByName(gone.select(F.lit("without").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_G} SELECT grid_id, CAST(coalesce(len(mgrs_tiles), 0) AS INT) AS n_tiles FROM grid")
def fillna_default(spark, d):
    return fx.grid(spark, d).withColumn("n_tiles", F.when(F.col("mgrs_tiles").isNotNull(), F.size("mgrs_tiles"))).fillna({"n_tiles": 0}).select("grid_id", "n_tiles")


@query(f"{_T} SELECT id FROM transects WHERE ymax >= -7e1 AND ymin <= 7e1")
def latitude_slice(spark, d):
    return fx.transects(spark, d).where(scan.overlaps((-180.0, -70.0, 180.0, 70.0), "xmin", "ymin", "xmax", "ymax")).select("id")


@query(f"{_T} SELECT CAST(id AS VARCHAR) AS name, country AS nation, CAST(rate AS FLOAT) AS change_rate, rate < 0 AS erodes FROM transects")
def rename_assign_cast(spark, d):
    t = fx.transects(spark, d).withColumnRenamed("country", "nation").withColumns({"name": F.col("id").cast("string"), "change_rate": F.col("rate").cast("float"), "erodes": F.col("rate") < 0})
    return t.drop("continent").select("name", "nation", "change_rate", "erodes")


@query(f"{with_views('items')} SELECT item_id, (xmax - xmin) * (ymax - ymin) > 1e2 AS too_large FROM items")
def roi_too_large(spark, d):
    """Whether a region covers more than 100 square degrees."""
    from tidemark.functions.planar import area, box_ring

    return fx.items(spark, d).select("item_id", (area(box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))) > 100).alias("too_large"))


@query(f"{_G} SELECT grid_id, coalesce(list_min(mgrs_tiles), 'none') AS tile, CAST(12 AS INT) AS zoom, CAST(ymin AS FLOAT) AS low FROM grid")
def resolved_inputs(spark, d):
    """A column with a default for what is missing, a value, and a column that is cast."""
    g = fx.grid(spark, d).withColumn("tile", F.array_min("mgrs_tiles"))
    return g.select("grid_id", scan.resolved(g, "tile", "tile", default="none").alias("tile"), scan.resolved(g, 12, "zoom", cast="int").alias("zoom"), scan.resolved(g, "ymin", "low", cast="float").alias("low"))


@query("SELECT n_nationkey, n_name, r_name, c.n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c ON c_nationkey = n_nationkey")
def index_join(spark, d):
    n, rg = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    c = fx.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(rg, n.n_regionkey == rg.r_regionkey).join(c, c.c_nationkey == n.n_nationkey, "left").select("n_nationkey", "n_name", "r_name", "n")


@query(f"{_T} SELECT id, country, {q('sum(abs(rate)) OVER (PARTITION BY country)')} AS total_rate FROM transects")
def group_total_on_rows(spark, d):
    return fx.transects(spark, d).select("id", "country", r(F.sum(F.abs("rate")).over(Window.partitionBy("country"))).alias("total_rate"))


@query(f"{_T} SELECT continent, shore_type, count(*) AS n, {q('avg(rate)')} AS mean_rate, CAST(grouping(continent) * 2 + grouping(shore_type) AS BIGINT) AS level FROM transects GROUP BY CUBE (continent, shore_type)")
def cube_of_classes(spark, d):
    return fx.transects(spark, d).cube("continent", "shore_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("rate")).alias("mean_rate"), F.grouping_id().alias("level"))


@query(f"{_T} SELECT continent, country, count(*) AS n FROM transects GROUP BY ROLLUP (continent, country)")
def rollup_of_places(spark, d):
    return fx.transects(spark, d).rollup("continent", "country").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_T} SELECT id, CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense, CAST(ntile(4) OVER (PARTITION BY country ORDER BY rate, id) AS INT) AS quarter FROM transects WINDOW w AS (PARTITION BY country ORDER BY coastal_type)")
def ranks_within_country(spark, d):
    w = Window.partitionBy("country")
    return fx.transects(spark, d).select("id", F.rank().over(w.orderBy("coastal_type")).alias("rank"), F.dense_rank().over(w.orderBy("coastal_type")).alias("dense"), F.ntile(4).over(w.orderBy("rate", "id")).alias("quarter"))


@query(f"{_T} SELECT id, 'cl' || country || 's' || (row_number() OVER (PARTITION BY country ORDER BY id) - 1) AS coastline_id FROM transects")
def segment_ids(spark, d):
    n = F.row_number().over(Window.partitionBy("country").orderBy("id")) - 1
    return fx.transects(spark, d).select("id", F.concat(F.lit("cl"), "country", F.lit("s"), n.cast("string")).alias("coastline_id"))


@query(f"{_T} SELECT id, country || '-' || lpad(CAST(row_number() OVER (PARTITION BY country ORDER BY id) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (PARTITION BY country ORDER BY id) AS VARCHAR))) AS INT), '0') AS grouped_id FROM transects")
def grouped_suffix(spark, d):
    return grids.with_group_index(fx.transects(spark, d), "country", ["id"]).select("id", "grouped_id")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM (SELECT o_orderstatus FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT o_orderstatus FROM orders WHERE o_totalprice < 100000) GROUP BY 1")
def concat_all(spark, d):
    o = fx.table(spark, d, "orders")
    both = o.where("o_totalprice < 50000").unionByName(o.where("o_totalprice < 100000"), allowMissingColumns=True)
    return both.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_G} SELECT grid_id || '.parquet' AS file FROM grid EXCEPT SELECT 'g' || (event_id % 90) || '.parquet' FROM events")
def files_to_make(spark, d):
    """Expected files less those there."""
    there = fx.table(spark, d, "events").select(F.concat(F.lit("g"), (F.col("event_id") % 90).cast("string"), F.lit(".parquet")).alias("file"))
    return fx.grid(spark, d).select(F.concat("grid_id", F.lit(".parquet")).alias("file")).subtract(there)


@query(f"{_G} SELECT grid_id, array_to_string(list_sort(list_distinct(list_concat(countries, ['NL', 'ZZ']))), ',') AS either, array_to_string(list_sort(list_intersect(countries, ['NL', 'RU', 'FR'])), ',') AS shared, array_to_string(list_sort(list_filter(countries, lambda x: NOT list_contains(['NL', 'RU', 'FR'], x))), ',') AS rest FROM grid")
def sets_of_names(spark, d):
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    shown = lambda c: F.array_join(F.array_sort(c), ",")
    return fx.grid(spark, d).select("grid_id", shown(F.array_union("countries", lit("NL", "ZZ"))).alias("either"), shown(F.array_intersect("countries", lit("NL", "RU", "FR"))).alias("shared"), shown(F.array_except("countries", lit("NL", "RU", "FR"))).alias("rest"))


@query("SELECT o_custkey, array_to_string(list_transform(list_sort(list_transform(list_distinct(s), lambda x: {'k': list_position(s, x), 'x': x})), lambda v: v.x), ',') AS statuses FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey)")
def distinct_in_order(spark, d):
    s = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    return fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_distinct(s), ",").alias("statuses"))


_LAST = "SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click'"


@query(
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT a.event_id, b.value AS last_value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def asof_join(spark, d):
    """Of each purchase, the value of the user's last click."""
    e = fx.table(spark, d, "events")
    b = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return intervals.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), b, ["user_id"], "ts", ["last_value"]).select("event_id", "last_value")


@query(
    """WITH s AS (SELECT event_id AS span_id, user_id, ts AS a, ts + INTERVAL 6 HOUR AS b FROM events WHERE event_type = 'purchase')
SELECT span_id, count(*) AS n FROM s JOIN events e ON e.user_id = s.user_id AND e.ts >= a AND e.ts < b GROUP BY span_id"""
)
def interval_join(spark, d):
    """Events of a user within six hours from each purchase."""
    e = fx.table(spark, d, "events")
    s = e.where("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), "user_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("b"))
    return intervals.within_intervals(e.select("user_id", "ts"), s, "ts", "a", "b", 6 * 3600.0, ["user_id"]).groupBy("span_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders WHERE month(o_orderdate) IN (7, 8, 9) GROUP BY 1")
def summer_by_year(spark, d):
    o = fx.table(spark, d, "orders").where(F.month("o_orderdate").isin(7, 8, 9))
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, make_timestamp(CAST(floor(epoch_us(o_orderdate) / 432000000000) AS BIGINT) * 432000000000) AS time_bin FROM orders")
def floor_to_days(spark, d):
    days = 5 * 86400
    return fx.table(spark, d, "orders").select("o_orderkey", F.timestamp_seconds(F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / days) * days).alias("time_bin"))


_DATES = "CASE event_id % 4 WHEN 0 THEN '2024-01-' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') WHEN 1 THEN '2024-02-29' WHEN 2 THEN '2023-02-29' ELSE 'x' END"


def _dates(spark, d):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat(F.lit("2024-01-"), F.lpad((k % 40).cast("string"), 2, "0"))).when(k % 4 == 1, "2024-02-29").when(k % 4 == 2, "2023-02-29").otherwise("x")
    return fx.table(spark, d, "events").select("event_id", text.alias("text"))


@query(f"SELECT event_id, regexp_full_match({_DATES}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({_DATES} AS DATE) IS NOT NULL AS valid FROM events")
def valid_dates(spark, d):
    from tidemark.functions.names import is_date

    return _dates(spark, d).select("event_id", is_date("text").alias("valid"))


@query(f"SELECT event_id, try_cast({_DATES} AS TIMESTAMP) AS at FROM events")
def parsed_times(spark, d):
    """Times of texts; what is no time is NULL."""
    return _dates(spark, d).select("event_id", F.expr("try_to_timestamp(text)").alias("at"))


@query(f"{_G} SELECT grid_id, 'z' || (CAST(substr(grid_id, 2) AS BIGINT) % 15) AS zoom, CAST(CAST(substr(grid_id, 2) AS BIGINT) % 15 AS INT) AS z, CAST(500 * (CAST(substr(grid_id, 2) AS BIGINT) % 7) AS INT) AS buffer FROM grid")
def zoom_and_buffer(spark, d):
    from tidemark.functions.names import zoom_of, buffer_of

    k = F.substring("grid_id", 2, 20).cast("long")
    name = F.concat(F.lit("grid_z"), (k % 15).cast("string"), F.lit("_"), (k % 7 * 500).cast("string"), F.lit("m.parquet"))
    return fx.grid(spark, d).withColumn("name", name).select("grid_id", F.concat(F.lit("z"), zoom_of("name").cast("string")).alias("zoom"), zoom_of("name").alias("z"), buffer_of("name").alias("buffer"))


@query(f"{_G} SELECT grid_id, array_to_string(list_sort(countries), ', ') AS text, CAST(len(countries) AS INT) AS n FROM grid")
def band_sets(spark, d):
    """Sets as sorted texts, and back."""
    g = fx.grid(spark, d).select("grid_id", F.array_join(F.array_sort("countries"), ", ").alias("text"))
    return g.withColumn("n", F.size(F.array_distinct(F.split("text", ", "))))


@query("SELECT min(CASE WHEN event_type = 'click' THEN ts END) AS datetime, min(ts) AS start_datetime, max(ts) AS end_datetime FROM events")
def merged_times(spark, d):
    """Time ranges of several tables as one: least, least start, greatest end, missing ones left out."""
    e = fx.table(spark, d, "events")
    some = e.groupBy("event_type").agg(F.min("ts").alias("start_datetime"), F.max("ts").alias("end_datetime"))
    some = some.withColumn("datetime", F.when(F.col("event_type") == "click", F.col("start_datetime")))
    return some.agg(F.min("datetime").alias("datetime"), F.min("start_datetime").alias("start_datetime"), F.max("end_datetime").alias("end_datetime"))


def _reset(spark, d):
    k = F.col("event_id") % 4
    e = fx.table(spark, d, "events")
    status = F.when(k == 0, L.SUCCESS).when(k == 1, L.FAILED).when(k == 2, L.PARTLY).otherwise(L.PROCESSING)
    return e.select(F.col("event_id").cast("string").alias("id"), status.alias("status"), F.col("event_type").alias("message"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 4 WHEN 0 THEN 'Success' WHEN 2 THEN 'Partly' ELSE 'Pending' END AS status, CASE WHEN event_id % 4 IN (1, 3) THEN '' ELSE event_type END AS message FROM events")
def worklog_reset(spark, d):
    return L.reset(_reset(spark, d), (L.PROCESSING, L.FAILED)).select("id", "status", "message")


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id, 'Pending' AS status, CAST(0 AS INT) AS retries, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 ELSE 0 END AS INT) AS priority FROM customer")
def worklog_priorities(spark, d):
    """A log of all customers, of which the events knew some before; priorities for even ids."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    log = L.validated(L.create(c.where("cast(id as bigint) % 3 = 0")), c, add_missing=True)
    given = c.where("cast(id as bigint) % 2 = 0").select("id", (F.col("id").cast("long") % 5).cast("int").alias("priority"))
    return L.assign_priority(log, given).select("id", "status", "retries", "priority")


@query(
    """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS id, list_sort(list(DISTINCT 'B' || (event_id % 3))) AS bands FROM events GROUP BY user_id)
SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(array_to_string(bands, ','), '') AS bands, CASE WHEN bands IS NULL THEN 'Pending' WHEN len(bands) = 3 THEN 'Success' ELSE 'Partly' END AS status FROM customer LEFT JOIN f ON f.id = CAST(c_custkey AS VARCHAR)"""
)
def worklog_from_storage(spark, d):
    """Bands found in file names, grouped by tile, then merged into a log."""
    e = fx.table(spark, d, "events").select(F.concat(F.lit("out/"), F.col("user_id").cast("string"), F.lit("_B"), (F.col("event_id") % 3).cast("string"), F.lit(".tif")).alias("path"))
    found = L.from_files(e, r"out/(\\d+)_(B\\d)\\.tif".replace("\\\\", "\\"))
    log = L.create(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id")))
    return L.update_from_files(log, found, ["B0", "B1", "B2"]).select("id", F.array_join("bands", ",").alias("bands"), "status")


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey || 's7'), c_custkey LIMIT 20")
def seeded_sample(spark, d):
    """Twenty rows drawn by a hash with a seed: the limit is what is asked for."""
    return fx.table(spark, d, "customer").select("c_custkey").orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("s7"))), "c_custkey").limit(20)


@query(f"{with_views('stac_items')} SELECT tile, count(*) AS n, min(id) AS first FROM stac_items GROUP BY tile")
def search_static_items(spark, d):
    """A search by place alone, for products without dates."""
    i = fx.stac_items(spark, d).withColumns({"xmin": F.col("tile") * 10.0, "ymin": F.lit(0.0), "xmax": F.col("tile") * 10.0 + 5, "ymax": F.lit(5.0)})
    return scan.search_items(i, (-180.0, -90.0, 180.0, 90.0)).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(f"{_T}, {'g AS (SELECT country, lon - avg(lon) OVER (PARTITION BY country) AS away, id FROM transects)'} SELECT id, {q('away', 4)} AS away FROM g")
def apply_per_group(spark, d):
    """A function over whole groups, in Arrow batches; groups are countries, a fixed number of them."""
    import pandas as pd

    def centred(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": g["id"], "away": g["lon"] - g["lon"].mean()})

    t = fx.transects(spark, d).select("country", "id", "lon")
    return t.groupBy("country").applyInPandas(centred, "id long, away double").select("id", r("away", 4).alias("away"))
