"""Coastal grid tables: admin filters, tiles, running ids, priorities, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import crs
from tidemark.functions.planar import ColumnOrName, col


def json_list(c: ColumnOrName) -> Column:
    """Texts of a JSON (or single-quoted) list; empty for NULL and empty text."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def filter_by_admins(grid: DataFrame, include_countries: Sequence[str] = (), include_continents: Sequence[str] = (), exclude_countries: Sequence[str] = (), exclude_continents: Sequence[str] = (), countries: str = "countries", continents: str = "continents") -> DataFrame:
    """Rows that have an included value; a row goes only if all of its values are excluded (one without values does)."""
    lit = lambda values: F.array(*[F.lit(v) for v in values])
    for c, values in ((continents, include_continents), (countries, include_countries)):
        if values:
            grid = grid.where(F.arrays_overlap(c, lit(values)))
    for c, values in ((continents, exclude_continents), (countries, exclude_countries)):
        if values:
            grid = grid.where(F.size(F.array_except(c, lit(values))) > 0)
    return grid


def by_mgrs_tile(grid: DataFrame, tiles: str = "mgrs_tiles", grid_id: str = "grid_id") -> DataFrame:
    """A row for each tile of each grid cell (NULL where it has none), with tile_id "tile_cell" and the zone's EPSG code."""
    df = grid.withColumn("mgrs_tile", F.explode_outer(tiles))
    return df.withColumns({"tile_id": F.concat_ws("_", "mgrs_tile", grid_id), "utm_epsg": crs.epsg_of_mgrs("mgrs_tile")})


def with_tile_numbers(df: DataFrame, tile: str = "mgrs_tile", order: Sequence[str] = ("grid_id",)) -> DataFrame:
    """tile_id "31UFU-00": a running number of two digits at least within each tile."""
    n = F.row_number().over(Window.partitionBy(tile).orderBy(*order)) - 1
    return df.withColumn("tile_id", F.format_string("%s-%02d", F.col(tile), n))


def with_group_index(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """key with a running number from 001 within it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("grouped_id", F.format_string("%s-%03d", F.col(key), n))


#: Latitudes between which tiles come before the remaining ones: fixed value.
POLEWARD = 70.0


def priority(continents: ColumnOrName = "continents", countries: ColumnOrName = "countries", ymin: ColumnOrName = "ymin", ymax: ColumnOrName = "ymax") -> Column:
    """10 to 6: the European Union without three neighbours, with two of them, the rest of it, the world, the poles."""
    eu, has = F.array_contains(continents, "EU"), lambda c: F.array_contains(countries, c)
    middle = (col(ymin) <= POLEWARD) & (col(ymax) >= -POLEWARD)
    return F.when(eu & ~has("RU") & ~has("NO") & ~has("SE"), 10).when(eu & ~has("RU"), 9).when(eu & middle, 8).when(~eu & middle, 7).otherwise(6)


def roll_up(df: DataFrame, quadkey: str, value: str, zooms: Sequence[int]) -> DataFrame:
    """Mean of values in cells of each zoom level, from the finest cells' sums and counts: the table is shuffled once, at the finest level."""
    finest = max(zooms)
    cells = df.groupBy(F.substring(quadkey, 1, finest).alias("__q")).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    wide = cells.select(F.explode(F.array(*[F.struct(F.lit(z).alias("zoom"), F.substring("__q", 1, z).alias("cell")) for z in zooms])).alias("c"), "__s", "__n")
    return wide.groupBy("c.zoom", "c.cell").agg((F.sum("__s") / F.nullif(F.sum("__n"), F.lit(0))).alias("mean"), F.sum("__n").alias("n"))


def percent_below(df: DataFrame, value: str, limit: float, keys: Sequence[str] = ()) -> DataFrame:
    """Share of values under a limit in percent, and their number, for each group."""
    return df.groupBy(*keys).agg((F.count_if(F.col(value) < limit) * 100.0 / F.nullif(F.count(value), F.lit(0))).alias("percent"), F.count(value).alias("n"))


def describe(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(value).alias("max"),
    )


def top_share(df: DataFrame, value: str, share: float, key: str) -> DataFrame:
    """The highest share of rows by value: hotspots."""
    n = int(df.count() * share)
    return df.orderBy(F.col(value).desc_nulls_last(), key).limit(n)


def local_moran(cells: DataFrame, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """Local Moran's I of grid cells with the eight neighbours that exist (row-standardised), and the quadrant; cells without neighbours have none.

    The neighbours meet by a shuffle join on their place, not by a cross join; mean and deviation are one row.
    """
    stats = cells.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d"))
    z = cells.crossJoin(F.broadcast(stats)).select(x, y, ((F.col(value) - F.col("__m")) / F.nullif(F.col("__d"), F.lit(0.0))).alias("z"))  # one row
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    sent = z.select((F.col(x)).alias("x0"), F.col(y).alias("y0"), F.col("z").alias("nz"), offsets.alias("o")).select((F.col("x0") + F.col("o.i")).alias(x), (F.col("y0") + F.col("o.j")).alias(y), "nz")
    lag = sent.groupBy(x, y).agg(F.avg("nz").alias("lag"), F.count(F.lit(1)).alias("neighbours"))
    out = z.join(lag, [x, y], "left").withColumn("moran_i", F.col("z") * F.col("lag"))
    quadrant = F.when((F.col("z") > 0) & (F.col("lag") > 0), "HH").when((F.col("z") < 0) & (F.col("lag") < 0), "LL").when((F.col("z") > 0) & (F.col("lag") < 0), "HL").when((F.col("z") < 0) & (F.col("lag") > 0), "LH")
    return out.withColumn("quadrant", quadrant)
