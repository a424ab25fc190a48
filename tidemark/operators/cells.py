"""Rasters as pixel tables: regions, windows, alignment, merged tiles, heights under lines, affine bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, col
from tidemark.functions.raster import composite_median, nodata_mask


def merged_tiles(df: DataFrame, bands: Sequence[str], keys: Sequence[str], time: str = "time") -> DataFrame:
    """Median over time of each cell, missing values left out, with the first and last time."""
    return composite_median(df, bands, keys).join(df.groupBy(*keys).agg(F.min(time).alias("first"), F.max(time).alias("last")), list(keys))


def region_class(region: Column, land: Column, sea: Column) -> Column:
    return F.when(sea, 3).when(land, 2).when(region, 1).otherwise(0)


def centres(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The centre of each raster in cells."""
    mid = lambda c: (F.min(c) + F.max(c) + 1) / F.lit(2.0)
    return df.groupBy(*keys).agg(mid("x").alias("x"), mid("y").alias("y"))


def window(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Cells from the one nearest to the lower corner to the one nearest to the upper; cells are named by their numbers."""
    near = lambda v: int(v + 0.5)
    return df.where(F.col("x").between(near(xmin), near(xmax)) & F.col("y").between(near(ymin), near(ymax)))


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variables of two rasters on one grid; cells of either are kept."""
    return a.join(b, list(keys), "full")


def classified(x: Column, limits: Sequence[float]) -> Column:
    """Number of limits that a value is above; NULL for a missing value."""
    out = F.lit(0)
    for k, limit in enumerate(sorted(limits), 1):
        out = F.when(x > limit, k).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x), out)


def under_lines(lines: DataFrame, pixels: DataFrame, keys: Sequence[str], line: str = "line", step: float = 0.25) -> DataFrame:
    """Pixels whose cell a two-vertex line runs through, each once: the line is walked in steps of a quarter of a cell, and the cells met are joined by their numbers."""
    a, b = F.get(line, F.lit(0)), F.get(line, F.lit(1))
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"])) / step)).cast("int")
    cell = lambda k: F.struct(F.floor(a["x"] + (b["x"] - a["x"]) * k / n).cast("int").alias("x"), F.floor(a["y"] + (b["y"] - a["y"]) * k / n).cast("int").alias("y"))
    met = lines.select(*keys, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n), cell))).alias("c")).select(*keys, "c.x", "c.y")
    return pixels.join(met, [*keys, "x", "y"])


def nodata_of(attribute: ColumnOrName, fill: ColumnOrName | None = None) -> Column:
    """The nodata value of a raster: its attribute, else its fill value; zero and NaN are none."""
    some = lambda c: F.when((col(c) != 0) & ~F.isnan(col(c).cast("double")), col(c))
    return some(attribute) if fill is None else F.coalesce(some(attribute), some(fill))


def is_nodata(band: ColumnOrName, nodata: Column) -> Column:
    return nodata_mask(band) | F.coalesce(col(band) == nodata, F.lit(False))


def with_item_metadata(chips: DataFrame, items: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """chips with columns of the items that they are of."""
    return chips.join(items.select(key, *columns), key)


def affine_bounds(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, width: float, height: float) -> Column:
    """struct<xmin, ymin, xmax, ymax> of the four corners of a raster under x = a * col + b * row + c, y = d * col + e * row + f."""
    xs = F.array(*[a * i + b * j + c for i in (0.0, width) for j in (0.0, height)])
    ys = F.array(*[d * i + e * j + f for i in (0.0, width) for j in (0.0, height)])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def is_rotated(a: Column, b: Column, d: Column, e: Column) -> Column:
    """Whether an affine transform turns by other than right angles: neither its diagonal nor the other one is zero."""
    zero = lambda x: F.abs(x) < 1e-12
    return ~((zero(b) & zero(d)) | (zero(a) & zero(e)))


def with_static_time(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """A raster without time with one step, from start to end; one that has several steps is an error."""
    if time in df.columns and df.select(time).distinct().limit(2).count() > 1:
        raise ValueError("the raster has more than one time step")
    return df.withColumns({time: F.to_timestamp_ntz(F.lit(start)), f"end_{time}": F.to_timestamp_ntz(F.lit(end))})


def as_byte(band: ColumnOrName, low: float, high: float) -> Column:
    """0 to 255 between two bounds, halves upwards; NULL for what is missing."""
    share = (col(band) - low) / (high - low)
    return F.when(~nodata_mask(band), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255 + 0.5).cast("int"))
