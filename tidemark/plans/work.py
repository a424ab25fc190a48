"""Item selection and work logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import items as I
from tidemark.operators import worklog as L
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import with_views

_S = with_views("stac_items")
_BIN = "CAST(floor(epoch_us(datetime) / 432000000000) AS BIGINT)"
_BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile, {_BIN} ORDER BY cloud_cover, id) AS k FROM stac_items) WHERE k = 1)"


@query(f"{_S}, {_BEST} SELECT tile, id, cloud_cover, make_timestamp({_BIN} * 432000000000) AS time_bin FROM best")
def best_per_bin(spark, d):
    return I.best_per_bin(fx.stac_items(spark, d), "tile").select("tile", "id", "cloud_cover", "time_bin")


@query(f"{_S} SELECT tile, CAST(CASE WHEN avg(cloud_cover) <= 10 THEN 10 WHEN avg(cloud_cover) <= 40 THEN 20 ELSE 30 END AS INT) AS quota FROM stac_items GROUP BY tile")
def quota_lookup(spark, d):
    return fx.stac_items(spark, d).groupBy("tile").agg(I.quota(F.avg("cloud_cover")).alias("quota"))


@query(
    f"""{_S}, {_BEST}, n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cloud_cover, id) AS r FROM best), g AS (SELECT CASE WHEN avg(cloud_cover) <= 10 THEN 10 WHEN avg(cloud_cover) <= 40 THEN 20 ELSE 30 END AS quota FROM best),
q AS (SELECT n.* FROM n, g WHERE r <= quota), b AS (SELECT n.* FROM n, g WHERE r > quota ORDER BY cloud_cover, id LIMIT greatest(0, 30 - (SELECT count(*) FROM q)))
SELECT id, tile, cloud_cover FROM (SELECT * FROM q UNION ALL SELECT * FROM b) ORDER BY cloud_cover, id LIMIT 30"""
)
def select_items(spark, d):
    """Thirty items at most: the limit is what is asked for."""
    return I.select_items(fx.stac_items(spark, d), ["tile"], groups=7).select("id", "tile", "cloud_cover")


@query(f"{_S} SELECT tile, id FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cloud_cover, id) AS r FROM stac_items) WHERE r <= 3")
def topn_backfill(spark, d):
    return I.top_per_group(fx.stac_items(spark, d), "tile", 3).select("tile", "id")


_STATUS = "CASE event_id % 4 WHEN 0 THEN 'Success' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Partly' ELSE 'Processing' END"


def _events(spark, d):
    e = fx.table(spark, d, "events")
    k = F.col("event_id") % 4
    status = F.when(k == 0, L.SUCCESS).when(k == 1, L.FAILED).when(k == 2, L.PARTLY).otherwise(L.PROCESSING)
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("event_type").alias("message"), F.date_format("ts", "yyyy-MM-dd").alias("datetime"), F.concat(F.lit("B"), (F.col("event_id") % 5).cast("string")).alias("band"))


def _log(spark, d):
    ids = fx.table(spark, d, "events").select(F.col("user_id").cast("string").alias("id")).distinct()
    log = L.create(ids)
    return L.assign_priority(log, ids.select("id", (F.col("id").cast("int") % 3).alias("priority")))


_MERGED = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, {_STATUS} AS status, event_type AS message, strftime(ts, '%Y-%m-%d') AS datetime, 'B' || (event_id % 5) AS band FROM events),
s AS (SELECT id, coalesce(max(seq) FILTER (WHERE status = 'Success'), -1) AS since, max(seq) AS last FROM e GROUP BY id),
m AS (SELECT s.id, (SELECT count(*) FROM e WHERE e.id = s.id AND e.seq > s.since AND e.status IN ('Failed', 'Partly')) AS retries, l.status, l.message AS said, l.datetime FROM s JOIN e l ON l.id = s.id AND l.seq = s.last),
b AS (SELECT id, list_sort(list(DISTINCT band)) AS bands FROM e GROUP BY id)"""


@query(
    f"""{_MERGED} SELECT m.id, status, array_to_string(bands, ',') AS bands, CAST(retries AS INT) AS retries, datetime, CASE WHEN status IN ('Failed', 'Partly') THEN said || ' (retry count: ' || retries || ')' ELSE said END AS message FROM m JOIN b ON m.id = b.id"""
)
def worklog_merge(spark, d):
    out = L.merge(_log(spark, d), _events(spark, d))
    return out.select("id", "status", F.array_join("bands", ",").alias("bands"), "retries", "datetime", "message")


@query(f"{_MERGED} SELECT status, count(*) AS n, CAST(sum(retries) AS BIGINT) AS retries FROM m GROUP BY status")
def worklog_counts(spark, d):
    out = L.merge(_log(spark, d), _events(spark, d))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("retries").alias("retries"))


@query(
    f"""{_MERGED} SELECT id, CASE WHEN list_has_all(bands, ['B0', 'B1', 'B2']) THEN 'Success' ELSE 'Partly' END AS status,
  CASE WHEN list_has_all(bands, ['B0', 'B1', 'B2']) THEN 'All bands processed.' ELSE 'Missing bands: ' || array_to_string(list_filter(['B0', 'B1', 'B2'], lambda x: NOT list_contains(bands, x)), ', ') END AS message FROM b"""
)
def band_completeness(spark, d):
    bands = _events(spark, d).groupBy("id").agg(F.collect_set("band").alias("bands"))
    status, message = L.completeness(F.col("bands"), ["B0", "B1", "B2"])
    return bands.select("id", status.alias("status"), message.alias("message"))


@query("WITH p AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, CAST(user_id % 3 AS INT) AS priority FROM events) SELECT id, priority FROM p WHERE priority = (SELECT max(priority) FROM p) ORDER BY id LIMIT 10")
def worklog_sample_order(spark, d):
    """Ten of the highest priority, in order of id: the limit is what is asked for."""
    return L.draw_in_order(_log(spark, d), 10).select("id", "priority")


@query("WITH p AS (SELECT DISTINCT user_id, user_id % 3 AS priority FROM events) SELECT count(*) AS n FROM p WHERE priority = (SELECT max(priority) FROM p)")
def worklog_to_process(spark, d):
    return L.to_process(_log(spark, d))
