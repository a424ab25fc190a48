"""Pixel algebra as column expressions over a long pixel table (one row per pixel, one column per band).

Missing is NULL: masks give NULL, never NaN, and a zero denominator gives NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.planar import ColumnOrName, col

#: Codes of the scene classification: fixed values.
SCENE_CLASSES = {
    "NO_DATA": 0,
    "SATURATED_DEFECTIVE": 1,
    "DARK_AREA_PIXELS": 2,
    "CLOUD_SHADOWS": 3,
    "VEGETATION": 4,
    "NOT_VEGETATED": 5,
    "WATER": 6,
    "UNCLASSIFIED": 7,
    "CLOUD_MEDIUM_PROBABILITY": 8,
    "CLOUD_HIGH_PROBABILITY": 9,
    "THIN_CIRRUS": 10,
    "SNOW_ICE": 11,
}


def scene_code(name: str | int) -> int:
    """Code of a class name (any case, blanks for underscores) or a code."""
    if isinstance(name, int):
        if name in SCENE_CLASSES.values():
            return name
    elif (key := name.upper().replace(" ", "_")) in SCENE_CLASSES:
        return SCENE_CLASSES[key]
    raise ValueError(f"unknown scene class: {name!r}")


# masks


def nodata_mask(band: ColumnOrName, nodata: float | None = None) -> Column:
    """Whether a cell is NULL, NaN, infinite or nodata."""
    x = col(band).cast("double")
    odd = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return odd if nodata is None else odd | F.coalesce(x == float(nodata), F.lit(False))


def numeric_mask(band: ColumnOrName, values: Iterable[float]) -> Column:
    return F.coalesce(col(band).isin(*values), F.lit(False))


def scene_mask(classes: Iterable[str | int], band: ColumnOrName = "SCL") -> Column:
    return numeric_mask(band, [scene_code(c) for c in classes])


def masked(band: ColumnOrName, mask: Column) -> Column:
    return F.when(~mask, col(band))


# scaling


def scaled(band: ColumnOrName, factor: float, offset: float = 0.0, nodata: int | None = None) -> Column:
    """smallint of (x - offset) * factor, halves to even; missing or too large becomes nodata."""
    x = F.when(~nodata_mask(band), F.bround((col(band).cast("double") - offset) * factor)).try_cast("smallint")
    return x if nodata is None else F.coalesce(x, F.lit(nodata).cast("smallint"))


def unscaled(band: ColumnOrName, factor: float, offset: float = 0.0, nodata: float | None = None) -> Column:
    return F.when(~nodata_mask(band, nodata), col(band).cast("double") * factor + offset)


# spectral indices


def _nd(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


_EVI = "2.5D * (nir - red) / nullif(nir + 6 * red - 7.5D * blue + 1, 0)"
#: Formulas over the bands blue, green, red, nir, swir16, swir22 and rededge1: fixed values.
INDICES: dict[str, str] = {
    "NDVI": _nd("nir", "red"),
    "kNDVI": f"tanh(power({_nd('nir', 'red')}, 2))",
    "EVI": _EVI,
    "LAI": f"3.618D * ({_EVI}) - 0.118D",
    "SAVI": "1.5D * (nir - red) / nullif(nir + red + 0.5D, 0)",
    "MSAVI": "(2 * nir + 1 - sqrt(nullif(greatest(power(2 * nir + 1, 2) - 8 * (nir - red), -1), -1))) / 2",
    "NDMI": _nd("nir", "swir16"),
    "NBR": _nd("nir", "swir22"),
    "BAI": "1 / nullif(power(0.10D - red, 2) + power(0.06D - nir, 2), 0)",
    "NDCI": _nd("rededge1", "red"),
    "NDSI": _nd("green", "swir16"),
    "NDTI": _nd("swir16", "swir22"),
    "NDWI": _nd("green", "nir"),
    "MNDWI": _nd("green", "swir16"),
    "NDBI": _nd("swir16", "nir"),
    "BUI": f"({_nd('swir16', 'nir')}) - ({_nd('nir', 'red')})",
    "BAEI": "(red + 0.3D) / nullif(green + swir16, 0)",
    "NBI": "(swir16 + red) / nullif(nir, 0)",
    "BSI": "((swir16 + red) - (nir + blue)) / nullif((swir16 + red) + (nir + blue), 0)",
    "AWEI_ns": "4 * (green - swir16) - (0.25D * nir + 2.75D * swir22)",
    "AWEI_sh": "blue + 2.5D * green - 1.5D * (nir + swir16) - 0.25D * swir22",
    "WI": "1.7204D + 171 * green + 3 * red - 70 * nir - 45 * swir16 - 71 * swir22",
    "TCW": "0.0315D * blue + 0.2021D * green + 0.3102D * red + 0.1594D * nir - 0.6806D * swir16 - 0.6109D * swir22",
    "TCG": "-0.1603D * blue - 0.2819D * green - 0.4934D * red + 0.7940D * nir - 0.0002D * swir16 - 0.1446D * swir22",
    "TCB": "0.2043D * blue + 0.4158D * green + 0.5524D * red + 0.5741D * nir + 0.3124D * swir16 - 0.2303D * swir22",
    "CMR": "swir16 / nullif(swir22, 0)",
    "FMR": "swir16 / nullif(nir, 0)",
    "IOR": "red / nullif(blue, 0)",
    "BR": _nd("blue", "red"),
}
BANDS = ("blue", "green", "red", "nir", "swir16", "swir22", "rededge1")


def bands_of(index: str) -> set[str]:
    return {b for b in BANDS if b in INDICES[index]}


def with_indices(df: DataFrame, names: str | Sequence[str], normalize: bool = True, drop: bool = False, nodata: float | None = None) -> DataFrame:
    """df with columns of the indices; normalize divides bands by 10000 first, drop leaves the indices alone with the key columns."""
    names = [names] if isinstance(names, str) else list(names)
    if unknown := [n for n in names if n not in INDICES]:
        raise ValueError(f"unknown indices: {unknown}")
    used = sorted(set().union(*map(bands_of, names)))
    if missing := [b for b in used if b not in df.columns]:
        raise ValueError(f"missing bands: {missing}")
    base = df.withColumns({b: F.nanvl(F.col(b).cast("double") / (10000.0 if normalize else 1.0), F.lit(None).cast("double")) for b in used})
    base = base.withColumns({n: F.coalesce(F.expr(INDICES[n]), F.lit(nodata)) if nodata is not None else F.expr(INDICES[n]) for n in names})
    return base.select(*[c for c in base.columns if c not in BANDS]) if drop else base


# scalers

#: Statistics of the model bands (min, max, mean, std_dev, clip_min, clip_max): fixed values.
BAND_STATISTICS = {
    "NDWI": (-0.55, 0.8, -0.05, 0.22, -0.45, 0.45),
    "blue": (800, 13000, 1560, 470, 1000, 4000),
    "green": (850, 12500, 1770, 570, 1100, 4300),
    "red": (800, 12500, 1660, 710, 1000, 5000),
    "nir": (790, 17205, 2520, 1440, 1000, 6500),
    "swir16": (770, 12450, 2100, 1200, 1000, 6000),
    "swir22": (760, 10150, 1780, 930, 1000, 5500),
}
_STATS = ("min", "max", "mean", "std_dev", "clip_min", "clip_max")
_NEEDS = {"min_max": ("min", "max"), "robust_min_max": ("clip_min", "clip_max"), "standard": ("mean", "std_dev")}


def band_statistics(band: str) -> dict[str, float]:
    return dict(zip(_STATS, map(float, BAND_STATISTICS[band]), strict=True))


def scaler(kind: str, band: ColumnOrName, stats: Mapping[str, float]) -> Column:
    """min_max and robust_min_max give 0 to 1, standard gives standard scores."""
    if kind not in _NEEDS:
        raise ValueError(f"unknown scaler: {kind!r}")
    if missing := [s for s in _NEEDS[kind] if s not in stats]:
        raise ValueError(f"statistics missing for {kind}: {missing}")
    a, b = (float(stats[s]) for s in _NEEDS[kind])
    x = col(band).cast("double")
    if kind == "standard":
        return (x - a) / b
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - a) / (b - a))))


def with_scaling(df: DataFrame, kinds: Mapping[str, str], stats: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    return df.withColumns({b: scaler(k, b, (stats or {}).get(b) or band_statistics(b)) for b, k in kinds.items()})


# transforms


def _relative(c: Column, name: str, by: Sequence[str]) -> tuple[str, Column]:
    return f"{name}_rel", c - F.min(c).over(Window.partitionBy(*by))


def _class_mask(which: tuple[int, ...], ending: str):
    def f(c: Column, name: str, by: Sequence[str]) -> tuple[str, Column]:
        return f"{name}{ending}", F.when(c.isNotNull(), c.isin(*which).cast("smallint"))

    return f


TRANSFORMS = {
    "nodata_mask": lambda c, name, by: (f"{name}_mask_nodata", nodata_mask(c).cast("smallint")),
    "relative": _relative,
    "roi_mask": _class_mask((1, 2, 3), "_mask_roi"),
    "landward_mask": _class_mask((2,), "_mask_landward"),
    "seaward_mask": _class_mask((3,), "_mask_seaward"),
}


def with_transforms(df: DataFrame, wanted: Mapping[str, str | Sequence[str]], by: Sequence[str] = ("cube_id",), merge: bool = True) -> DataFrame:
    """Feature columns: transform name to band names; by: the columns within which `relative` takes its minimum."""
    found = {}
    for kind, names in wanted.items():
        if kind not in TRANSFORMS:
            raise ValueError(f"unknown transform: {kind!r}")
        for n in [names] if isinstance(names, str) else names:
            k, c = TRANSFORMS[kind](F.col(n), n, by)
            found[k] = c
    df = df.withColumns(found)
    return df if merge else df.select(*[c for c in df.columns if c in found or c in ("cube_id", "time", "y", "x")])


# composites


def composite_median(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Median over time of each pixel, missing values left out."""
    return df.groupBy(*keys).agg(*[F.median(F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double"))).alias(b) for b in bands])


def composite_percentile(df: DataFrame, bands: Sequence[str], q: float, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Percentile over time; a pixel with any missing value is missing."""
    if not 0 <= q <= 100:
        raise ValueError("q must be from 0 to 100")
    return df.groupBy(*keys).agg(*[F.when(~F.bool_or(nodata_mask(b)), F.percentile(F.col(b).cast("double"), F.lit(q / 100.0))).alias(b) for b in bands])


def composite_metadata(items: DataFrame, keys: Sequence[str] = (), when: str = "datetime", cloud: str = "cloud_cover", item: str = "id") -> DataFrame:
    """First and last time, mean days between items, number, whole mean cloud cover and ids of a composite's items."""
    micros = lambda f: F.unix_micros(f(F.col(when).cast("timestamp")))
    days = (micros(F.max) - micros(F.min)) / 86_400_000_000
    return items.groupBy(*keys).agg(
        F.min(when).alias("start_datetime"), F.max(when).alias("end_datetime"), F.try_divide(days, F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("mean_gap_days"),
        F.count(F.lit(1)).alias("n_obs"), F.floor(F.avg(cloud)).alias("cloud_cover"), F.array_sort(F.collect_list(item)).alias("ids"),
    )


def combine_first(frames: Sequence[DataFrame], bands: Sequence[str], keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """The first value that is there, over rasters in order, pixel by pixel: one aggregation, however many rasters."""
    if not frames:
        raise ValueError("no raster to combine")
    tagged = [f.select(*keys, F.lit(k).alias("__k"), *[F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double")).alias(b) for b in bands]) for k, f in enumerate(frames)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return both.groupBy(*keys).agg(*[F.min_by(b, F.when(F.col(b).isNotNull(), F.col("__k"))).alias(b) for b in bands])


def trim(df: DataFrame, band: str, keys: Sequence[str] = ("cube_id",), crop: int = 0) -> DataFrame:
    """Pixels within the rows and columns that hold data, y and x from 0, less crop cells on each side; a cube without data is left as it is."""
    w = Window.partitionBy(*keys)
    here = F.when(~nodata_mask(band), F.struct("y", "x"))
    edges = {f"__{f.__name__}_{a}": f(here[a]).over(w) for a in ("y", "x") for f in (F.min, F.max)}
    df = df.withColumns(edges)
    inside = F.lit(True)
    for a in ("y", "x"):
        inside = inside & F.coalesce(F.col(a).between(F.col(f"__min_{a}") + crop, F.col(f"__max_{a}") - crop), F.lit(True))
    out = df.where(inside)
    out = out.withColumns({a: F.coalesce(F.col(a) - F.col(f"__min_{a}") - crop, F.col(a)) for a in ("y", "x")})
    return out.drop(*edges)


def otsu(df: DataFrame, band: str, keys: Sequence[str], bins: int = 256) -> DataFrame:
    """Threshold of greatest between-class variance for each group, on a histogram of equal bins between the group's extremes."""
    x = F.nanvl(F.col(band).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, x.alias("v")).where("v is not null")
    ends = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = rows.join(ends, list(keys))
    width = (F.col("hi") - F.col("lo")) / bins
    rows = rows.withColumn("bin", F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise(0))
    hist = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    whole = Window.partitionBy(*keys)
    low = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("mid", mid).withColumn("w", F.sum("n").over(low)).withColumn("s", F.sum(F.col("n") * F.col("mid")).over(low))
    hist = hist.withColumn("tw", F.sum("n").over(whole)).withColumn("ts", F.sum(F.col("n") * F.col("mid")).over(whole))
    gap = F.col("s") / F.col("w") - F.try_divide(F.col("ts") - F.col("s"), F.nullif(F.col("tw") - F.col("w"), F.lit(0)))
    between = F.col("w") * (F.col("tw") - F.col("w")) * gap * gap
    return hist.withColumn("between", between).groupBy(*keys).agg(F.coalesce(F.max_by("mid", F.struct(F.nullif(F.col("between"), F.lit(0.0)), -F.col("bin"))), F.max("lo")).alias("threshold"), F.max("tw").alias("n"))
