"""Names, sizes, paths, encodings and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import partition, typology
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views


@query("SELECT p_partkey, substr(md5(p_name), 1, 6) AS short FROM part")
def short_hash(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", names.short_id("p_name").alias("short"))


def _half(pos: str, neg: str, v: str, width: int) -> str:
    return f"(CASE WHEN {v} >= 0 THEN '{pos}' ELSE '{neg}' END) || lpad(CAST(CAST(round_even(abs({v}), 0) AS BIGINT) AS VARCHAR), CAST(greatest({width}, length(CAST(CAST(round_even(abs({v}), 0) AS BIGINT) AS VARCHAR))) AS INT), '0')"


@query(f"{with_views('transects')} SELECT id, {_half('n', 's', 'lat', 2)} || {_half('e', 'w', 'lon', 3)} AS name FROM transects")
def bounds_name(spark, d):
    return fx.transects(spark, d).select("id", names.bounds_name("lon", "lat").alias("name"))


@query(
    f"""{with_views('transects')} SELECT id, {_half('n', 's', 'ymin', 2)} || {_half('e', 'w', 'xmin', 2)} || '-' || substr(md5(printf('%.6f_%.6f_%.6f_%.6f', xmin, ymin, xmax, ymax)), 1, 6) AS name FROM transects"""
)
def bounds_name_with_hash(spark, d):
    return fx.transects(spark, d).select("id", names.bounds_name_with_hash("xmin", "ymin", "xmax", "ymax").alias("name"))


@query("SELECT p_partkey, CAST(p_size * 1048576 AS BIGINT) AS bytes FROM part")
def size_parse(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", names.bytes_of(F.concat(F.col("p_size").cast("string"), F.lit("MB"))).alias("bytes"))


@query("""WITH v AS (SELECT doc_id, CAST(n_chars AS DOUBLE) * 1000 AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024e0 THEN printf('%.2f B', n) WHEN n < 1048576e0 THEN printf('%.2f KB', n / 1024e0) WHEN n < 1073741824e0 THEN printf('%.2f MB', n / 1048576e0) ELSE printf('%.2f GB', n / 1073741824e0) END AS size FROM v""")
def readable_size(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", names.readable_bytes(F.col("n_chars") * 1000).alias("size"))


@query(r"""WITH p AS (SELECT url, regexp_replace(url, '[?#].*$', '') AS u FROM pages), n AS (SELECT url, regexp_extract(u, '([^/]*)$', 1) AS f FROM p)
SELECT url, regexp_extract(url, '^([a-z0-9+.-]+)://', 1) AS protocol, f AS filename, regexp_replace(f, '\.[^.]*$', '') AS stem, regexp_extract(f, '(\.[^.]*)$', 1) AS suffix FROM n""")
def path_parse(spark, d):
    return fx.table(spark, d, "pages").select("url", names.protocol("url").alias("protocol"), names.file_name("url").alias("filename"), names.stem("url").alias("stem"), names.suffix("url").alias("suffix"))


@query(
    f"""{with_views('transects')}, p AS (SELECT id, transect_id, regexp_extract(transect_id, '^cl(\\d+)s', 1) AS a, regexp_extract(transect_id, 's(\\d+)tr', 1) AS b, regexp_extract(transect_id, 'tr(\\d+)$', 1) AS c FROM transects),
w AS (SELECT max(length(a)) AS wa, max(length(b)) AS wb, max(length(c)) AS wc FROM p)
SELECT id, 'cl' || lpad(a, CAST(wa AS INT), '0') || 's' || lpad(b, CAST(wb AS INT), '0') || 'tr' || lpad(c, CAST(wc AS INT), '0') AS padded FROM p, w"""
)
def zero_pad_ids(spark, d):
    t = fx.transects(spark, d).select("id", "transect_id")
    part = lambda k: F.max(F.length(F.regexp_extract("transect_id", r"^cl(\d+)s(\d+)tr(\d+)$", k)))
    widths = t.agg(*[part(k).alias(f"w{k}") for k in (1, 2, 3)])  # one row
    wide = t.crossJoin(F.broadcast(widths))
    return wide.select("id", names.zero_padded_ids("transect_id", (F.col("w1"), F.col("w2"), F.col("w3"))).alias("padded"))


_SEGMENTS = {"automobile": 0, "building": 1, "furniture": 2, "machinery": 3}


@query(
    f"""{with_views('transects')} SELECT id, CAST(CASE lower(shore_type) WHEN 'automobile' THEN 0 WHEN 'building' THEN 1 WHEN 'furniture' THEN 2 WHEN 'machinery' THEN 3 END AS INT) AS code FROM transects"""
)
def encode_category(spark, d):
    return fx.transects(spark, d).select("id", typology.encoded("shore_type", _SEGMENTS).alias("code"))


@query(f"{with_views('transects')} SELECT DISTINCT label, value FROM (SELECT 'shore_type' AS label, lower(shore_type) AS value FROM transects UNION ALL SELECT 'coastal_type', lower(coastal_type) FROM transects)")
def observed_classes(spark, d):
    return typology.observed(fx.transects(spark, d), ["shore_type", "coastal_type", "not_there"])


@query(
    """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, k, CAST(n_chars AS BIGINT) AS held, CAST(0 AS BIGINT) AS part FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN f.held > 20000 THEN o.n_chars ELSE f.held + o.n_chars END, CASE WHEN f.held > 20000 THEN f.part + 1 ELSE f.part END FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, doc_id, part FROM f"""
)
def equal_size_partition_ids(spark, d):
    t = fx.table(spark, d, "documents")
    return partition.equal_size(t.select("source", "doc_id", "n_chars"), "n_chars", 20_000, ["doc_id"], "source").select("source", "doc_id", "part")


@query(f"SELECT o_orderkey, {q('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)', 2)} AS running FROM orders")
def running_total(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return fx.table(spark, d, "orders").select("o_orderkey", r(F.sum("o_totalprice").over(w), 2).alias("running"))
