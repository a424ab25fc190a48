"""Parquet, CSV and item tables: writing, listing, and what a data set's item says about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path in any store that Hadoop reads; 0 where there is nothing."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def write_parquet(df: DataFrame, path: str, overwrite: bool = True, partition_by: Sequence[str] = ()) -> int:
    """Bytes written.  An empty table writes nothing (0); without overwrite an existing path stays as it is."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if not overwrite and fs.exists(p):
        return size_of(spark, path)
    if df.isEmpty():
        return 0
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return size_of(spark, path)


def delete(spark: SparkSession, pattern: str, confirmed: bool = False) -> list[str]:
    """Paths that match a pattern; they are deleted only when confirmed."""
    fs, p = _fs(spark, pattern)
    found = [str(s.getPath()) for s in (fs.globStatus(p) or [])]
    if confirmed:
        for f in found:
            fs.delete(_fs(spark, f)[1], True)
    return found


def columns_of(schema: StructType, prefix: str = "") -> list[dict[str, str]]:
    """name and type of each column, structs taken apart with dots, in the way that catalogues list them."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, StructType):
            out += columns_of(f.dataType, f"{name}.")
        elif isinstance(f.dataType, ArrayType):
            out.append({"name": name, "type": f"list<{f.dataType.elementType.simpleString()}>"})
        else:
            out.append({"name": name, "type": "byte_array" if f.name == "geometry" else f.dataType.simpleString()})
    return out


def table_items(df: DataFrame, bbox: str | None = "bbox", when: str | None = None, datetimes: str = "range") -> DataFrame:
    """One row per file: href, rows, bounds and times, all files in one aggregation.

    datetimes: no, range (first and last), midpoint, or unique (an error value of NULL where a file has several).
    """
    if datetimes not in ("no", "range", "midpoint", "unique"):
        raise ValueError("datetimes must be no, range, midpoint or unique")
    aggs = [F.count(F.lit(1)).alias("row_count")]
    if bbox:
        aggs += [f(F.col(f"{bbox}.{e}")).alias(e) for f, e in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    if when and datetimes != "no":
        low, high = F.min(F.col(when).cast("timestamp")), F.max(F.col(when).cast("timestamp"))
        if datetimes == "range":
            aggs += [low.alias("start_datetime"), high.alias("end_datetime")]
        elif datetimes == "midpoint":
            aggs.append(F.timestamp_micros(((F.unix_micros(low) + F.unix_micros(high)) / 2).cast("bigint")).alias("datetime"))
        else:
            aggs.append(F.when(low == high, low).alias("datetime"))
    return df.groupBy(F.col("_metadata.file_path").alias("href")).agg(*aggs)


def bounds(df: DataFrame, bbox: str = "bbox") -> DataFrame:
    """Bounds of a whole table, partial in each task."""
    return df.agg(*[f(F.col(f"{bbox}.{e}")).alias(n) for f, e, n in ((F.min, "xmin", "minx"), (F.min, "ymin", "miny"), (F.max, "xmax", "maxx"), (F.max, "ymax", "maxy"))])


def collate(items: DataFrame, key: str = "id", assets: str = "assets", order: str = "seq") -> DataFrame:
    """Items of one id with their assets (a map) put together; a later asset of a name wins."""
    pairs = items.select(key, order, F.explode(assets).alias("k", "v"))
    last = pairs.groupBy(key, "k").agg(F.max_by("v", order).alias("v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(assets))


def item_path(key: str = "id", layout: str = "flat") -> Column:
    """items/<id>.json, or for layout prefix <first two parts of the id>/<id>.json."""
    k = F.col(key).cast("string")
    if layout == "flat":
        return F.concat(F.lit("items/"), k, F.lit(".json"))
    parts = F.split(k, "_")
    return F.concat(F.concat_ws("-", F.slice(parts, 1, 2)), F.lit("/"), k, F.lit(".json"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
