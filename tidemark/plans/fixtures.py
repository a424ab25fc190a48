"""Coastal tables derived from the given star schema by integer arithmetic, for Spark and, the same, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.planar import point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transect for each customer; nations and regions are dimension tables of fixed size."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    dims = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    k = F.col("c_custkey")
    lon, lat = (k * 37) % 3600 / 10.0 - 180.0, (k * 53) % 1600 / 10.0 - 80.0
    df = c.join(dims, c.c_nationkey == dims.n_nationkey).select(
        k.alias("id"), F.concat(F.lit("cl"), F.col("c_nationkey").cast("string"), F.lit("s0tr"), k.cast("string")).alias("transect_id"), lon.alias("lon"), lat.alias("lat"),
        F.col("n_name").alias("country"), F.col("r_name").alias("continent"), F.col("c_mktsegment").alias("shore_type"), F.concat(F.lit("type"), (k % 5).cast("string")).alias("coastal_type"), ((F.col("c_acctbal") - 5000) / 1000).alias("rate"),
    )
    lon, lat = F.col("lon"), F.col("lat")
    return df.withColumns({"xmin": lon - 0.01, "ymin": lat - 0.01, "xmax": lon + 0.01, "ymax": lat + 0.01})


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """df over all cores by a key, for rows that take long: a file of one row group is one task, however many rows it has."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A footprint of 14.4 degrees for each nation."""
    n = table(spark, sf_dir, "nation")
    x = F.col("n_nationkey") * 14.4 - 180.0
    return n.select(F.col("n_nationkey").cast("long").alias("item_id"), F.concat(F.lit("az://data/part-"), F.col("n_nationkey").cast("string"), F.lit(".parquet")).alias("href"), x.alias("xmin"), F.lit(-80.0).alias("ymin"), (x + 14.4).alias("xmax"), F.lit(80.0).alias("ymax"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("transect_id"), F.col("l_shipdate").alias("datetime"), F.col("l_quantity").alias("chainage"), (F.col("l_returnflag") != "R").alias("obs_is_primary"), "l_orderkey", "l_linenumber")


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("user_id", "ts", "event_id", F.col("value").alias("actual"), (F.col("value") * 0.8 + (F.col("event_id") % 7)).alias("predicted"))


def stac_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("datetime"), (F.floor(F.col("o_totalprice")) % 100).cast("double").alias("cloud_cover"), (F.col("o_custkey") % 7).alias("tile"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of 8 x 8 from embeddings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    v, p = F.col("v").cast("double"), F.col("pos")
    band = lambda a, b: F.lit(a) + v * b
    return e.select(
        F.col("vec_id").alias("cube_id"), F.floor(p / 8).cast("int").alias("y"), (p % 8).cast("int").alias("x"), band(0.6, 1.0).alias("blue"), band(0.7, 0.5).alias("green"), band(0.65, 0.8).alias("red"), band(0.9, -0.6).alias("nir"),
        band(0.8, 0.3).alias("swir16"), band(0.7, -0.4).alias("swir22"), band(0.75, 0.6).alias("rededge1"), ((F.col("vec_id") + p) % 12).cast("int").alias("SCL"), (v * 10.0).alias("deltadtm"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each nation through all its customers in order of id."""
    t = transects(spark, sf_dir)
    return t.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("id", "lon", "lat"))).alias("v")).select("country", F.transform("v", lambda s: point(s["lon"], s["lat"])).alias("line"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells from suppliers: MGRS-like tiles, countries and continents as lists."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    some = lambda values, *picks: F.array_distinct(F.array(*[F.element_at(F.array(*[F.lit(v) for v in values]), (p % len(values) + 1).cast("int")) for p in picks]))
    lat = (k * 53) % 1800 / 10.0 - 90.0
    return s.select(
        F.concat(F.lit("g"), k.cast("string")).alias("grid_id"), some(CONTINENTS, k).alias("continents"), some(COUNTRIES, k, k * 3).alias("countries"),
        F.when(k % 11 != 0, some(TILES, k, k * 5)).alias("mgrs_tiles"), lat.alias("ymin"), (lat + 1).alias("ymax"),
    )


CONTINENTS = ("EU", "AS", "AF", "NA", "SA")
COUNTRIES = ("NL", "RU", "NO", "SE", "FR", "US", "IN")
TILES = ("31UFU", "32TNS", "18HYD", "05KLT", "55GEM")


def _list(values, *picks: str) -> str:
    return "list_distinct([" + ", ".join(f"['{"', '".join(values)}'][CAST({p} % {len(values)} AS BIGINT) + 1]" for p in picks) + "])"


#: The same as common table expressions.
_T = """transects0 AS (
  SELECT c_custkey AS id, 'cl' || c_nationkey || 's0tr' || c_custkey AS transect_id, (c_custkey * 37) % 3600 / 1e1 - 18e1 AS lon, (c_custkey * 53) % 1600 / 1e1 - 8e1 AS lat,
    n_name AS country, r_name AS continent, c_mktsegment AS shore_type, 'type' || (c_custkey % 5) AS coastal_type, (c_acctbal - 5000) / 1000 AS rate
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
transects AS (SELECT *, lon - 1e-2 AS xmin, lat - 1e-2 AS ymin, lon + 1e-2 AS xmax, lat + 1e-2 AS ymax FROM transects0)"""
_VIEWS = {
    "transects": _T,
    "items": "items AS (SELECT CAST(n_nationkey AS BIGINT) AS item_id, 'az://data/part-' || n_nationkey || '.parquet' AS href, n_nationkey * 144e-1 - 18e1 AS xmin, -8e1 AS ymin, n_nationkey * 144e-1 - 18e1 + 144e-1 AS xmax, 8e1 AS ymax FROM nation)",
    "series": "series AS (SELECT l_suppkey AS transect_id, l_shipdate AS datetime, l_quantity AS chainage, l_returnflag <> 'R' AS obs_is_primary, l_orderkey, l_linenumber FROM lineitem)",
    "forecast": "forecast AS (SELECT user_id, ts, event_id, value AS actual, value * 8e-1 + (event_id % 7) AS predicted FROM events)",
    "stac_items": "stac_items AS (SELECT o_orderkey AS id, o_orderdate AS datetime, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS cloud_cover, o_custkey % 7 AS tile FROM orders)",
    "pixels": """pixels0 AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
pixels AS (SELECT vec_id AS cube_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, 6e-1 + v AS blue, 7e-1 + v * 5e-1 AS green, 65e-2 + v * 8e-1 AS red, 9e-1 + v * -6e-1 AS nir,
  8e-1 + v * 3e-1 AS swir16, 7e-1 + v * -4e-1 AS swir22, 75e-2 + v * 6e-1 AS rededge1, CAST((vec_id + pos) % 12 AS INT) AS SCL, v * 1e1 AS deltadtm FROM pixels0)""",
    "lines": f"""{_T},
lines AS (SELECT country, list({{'x': lon, 'y': lat}} ORDER BY id) AS line FROM transects GROUP BY country)""",
    "grid": f"""grid AS (SELECT 'g' || s_suppkey AS grid_id, {_list(CONTINENTS, "s_suppkey")} AS continents, {_list(COUNTRIES, "s_suppkey", "s_suppkey * 3")} AS countries,
  CASE WHEN s_suppkey % 11 <> 0 THEN {_list(TILES, "s_suppkey", "s_suppkey * 5")} END AS mgrs_tiles, (s_suppkey * 53) % 1800 / 1e1 - 9e1 AS ymin, (s_suppkey * 53) % 1800 / 1e1 - 9e1 + 1 AS ymax FROM supplier)""",
}


def with_views(*names: str) -> str:
    """WITH clause that defines the views of these names."""
    if "lines" in names:
        names = tuple(n for n in names if n != "transects")
    return "WITH " + ",\n".join(_VIEWS[n] for n in names)


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, as engines differ in the last digit of elementary functions; zero has no sign."""
    return F.round(c, digits) + F.lit(0.0)


def q(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"
