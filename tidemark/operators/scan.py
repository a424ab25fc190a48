"""Catalogued scans: files pruned by their footprints, rows by pushed-down bounds, columns by the projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, col

Box = tuple[float, float, float, float]


def overlaps(box: Box, xmin: ColumnOrName = "bbox.xmin", ymin: ColumnOrName = "bbox.ymin", xmax: ColumnOrName = "bbox.xmax", ymax: ColumnOrName = "bbox.ymax") -> Column:
    """Bounds meet the box, edges included; four comparisons that the Parquet reader takes over."""
    x0, y0, x1, y1 = map(float, box)
    return (col(xmin) <= x1) & (col(ymin) <= y1) & (col(xmax) >= x0) & (col(ymax) >= y0)


def within(box: Box, xmin: ColumnOrName = "bbox.xmin", ymin: ColumnOrName = "bbox.ymin", xmax: ColumnOrName = "bbox.xmax", ymax: ColumnOrName = "bbox.ymax") -> Column:
    """Bounds lie strictly inside the box."""
    x0, y0, x1, y1 = map(float, box)
    return (col(xmin) > x0) & (col(ymin) > y0) & (col(xmax) < x1) & (col(ymax) < y1)


def point_in(box: Box, x: ColumnOrName, y: ColumnOrName) -> Column:
    x0, y0, x1, y1 = map(float, box)
    return col(x).between(x0, x1) & col(y).between(y0, y1)


def matching_files(items: DataFrame, rois: DataFrame, href: str = "href") -> DataFrame:
    """Distinct files whose footprint (xmin, ymin, xmax, ymax) meets any box of rois; the boxes of a query are few and are counted before they are broadcast."""
    r = rois.select(*[F.col(c).alias(f"r_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    meets = (F.col("xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("ymax"))
    if r.limit(MANY_BOXES + 1).count() <= MANY_BOXES:
        return items.join(F.broadcast(r), meets, "left_semi").select(href).distinct()
    from tidemark.operators.joins import box_join

    named = items.withColumn("__item", F.col(href))
    pairs = box_join(named.select("__item", "xmin", "ymin", "xmax", "ymax"), rois.withColumn("__roi", F.monotonically_increasing_id()), "__item", "__roi")
    return pairs.select(F.col("__item").alias(href)).distinct()


#: Regions of interest up to which they are broadcast to the footprints.
MANY_BOXES = 1000


@dataclass
class Catalog:
    """A collection: one row per file in items (href, xmin, ymin, xmax, ymax), and the declared columns."""

    spark: SparkSession
    items: DataFrame
    columns: Sequence[str] = ()
    bbox: str = "bbox"

    def files(self, box: Box) -> list[str]:
        """Files whose footprint meets the box.  The list of files of one query goes through the driver, as Spark's reader takes it from there."""
        return sorted(r["href"] for r in self.items.where(overlaps(box, "xmin", "ymin", "xmax", "ymax")).select("href").distinct().collect())

    def _checked(self, columns: Sequence[str] | None) -> list[str] | None:
        if columns is None:
            return None
        known = list(self.columns)
        if known and (unknown := [c for c in columns if c not in known]):
            raise ValueError(f"unknown columns: {unknown}")
        return list(columns) + (["geometry"] if "geometry" in known and "geometry" not in columns else [])

    def fetch(self, box: Box, columns: Sequence[str] | None = None, mode: str = "overlap") -> DataFrame:
        """Rows whose bbox overlaps (or, mode within, lies strictly inside) the box, from the files that can hold any."""
        if mode not in ("overlap", "within"):
            raise ValueError("mode must be overlap or within")
        wanted = self._checked(columns)
        files = self.files(box)
        b = self.bbox
        if not files:
            first = self.items.select("href").first()
            df = self.spark.read.parquet(first["href"]).where(F.lit(False)) if first else self.spark.createDataFrame([], "geometry binary")
        else:
            test = overlaps if mode == "overlap" else within
            df = self.spark.read.parquet(*files).where(test(box, f"{b}.xmin", f"{b}.ymin", f"{b}.xmax", f"{b}.ymax"))
        return df.select(*[F.col(f"`{c}`") for c in wanted]) if wanted else df

    def fetch_polygon(self, wkt_ring: Sequence[tuple[float, float]], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows whose geometry (WKB) meets a polygon: bounds first, then the exact test in Arrow batches."""
        from tidemark.functions.wkb import intersects_polygon

        xs, ys = [p[0] for p in wkt_ring], [p[1] for p in wkt_ring]
        return self.fetch((min(xs), min(ys), max(xs), max(ys)), columns).where(intersects_polygon(wkt_ring)("geometry"))


def sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Any SQL over named frames; an empty result keeps its schema."""
    return spark.sql(query, **frames)


def snapshot(spark: SparkSession, path: str, columns: Sequence[str] | None = None, add_href: bool = True) -> DataFrame:
    """Items of a snapshot; with a single `data` asset its address becomes href and the alternate link alternate_href, otherwise there is a column href_<asset> for each asset."""
    df = spark.read.parquet(path)
    names = df.schema["assets"].dataType.fieldNames() if hasattr(df.schema["assets"].dataType, "fieldNames") else None
    wanted = [c for c in (columns or df.columns) if c != "assets"]
    if not add_href:
        return df.select(*wanted, "assets")
    if names is None or names == ["data"]:
        extra = [F.col("assets")["data"]["href"].alias("href")]
        if "links" in df.columns:
            extra.append(alternate_href("links").alias("alternate_href"))
    else:
        extra = [F.col("assets")[a]["href"].alias(f"href_{a}") for a in names]
    return df.select(*wanted, *extra)


def alternate_href(links: ColumnOrName) -> Column:
    return F.try_element_at(F.filter(col(links), lambda x: x["rel"] == "alternate"), F.lit(1))["href"]


def search_items(items: DataFrame, box: Box, start=None, end=None, max_cloud: float | None = None, limit: int | None = None) -> DataFrame:
    """Image items that meet a box, within a time range (both ends included), least cloudy first where cloud cover is asked about."""
    df = items.where(overlaps(box, "xmin", "ymin", "xmax", "ymax"))
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("datetime") <= F.lit(end))
    if max_cloud is not None:
        df = df.where(F.col("cloud_cover") <= max_cloud).orderBy(F.col("cloud_cover").asc_nulls_last(), "id")
    return df.limit(limit) if limit is not None else df


def resolved(df: DataFrame, value, name: str, default=None, cast: str | None = None, required: bool = False) -> Column:
    """A column of df by its name, or a literal value, or the default; missing values become the default, and all is cast.  A required input that is neither there nor has a default is an error."""
    if isinstance(value, str) and value in df.columns:
        out = F.col(f"`{value}`")
    elif value is not None and not isinstance(value, str):
        out = F.lit(value)
    elif required and default is None:
        raise ValueError(f"{name} is needed: {value!r} is no column")
    else:
        out = F.lit(None)
    if cast:
        out = out.cast(cast)
    if default is not None:
        out = F.coalesce(out, F.lit(default).cast(cast) if cast else F.lit(default))
    return out.alias(name)
