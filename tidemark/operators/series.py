"""Shoreline series: trends, validity, and projections along transects."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import crs, planar
from tidemark.functions.planar import ColumnOrName, col
from tidemark.functions.samples import array_quantile, nan_to_null, normal_bounds
from tidemark.functions.trends import ols


def trend(series: DataFrame, key: str, when: str, position: str, primary: str | None = "obs_is_primary") -> DataFrame:
    """Change per year of each transect by least squares over its primary observations, x being the year; NULL under three of them."""
    rows = series.where(F.col(primary)) if primary else series
    fit = ols(F.year(when), nan_to_null(position))
    return rows.groupBy(key).agg(fit["slope"].alias("change_rate"), fit["intercept"].alias("change_intercept"), fit["slope_se"].alias("change_rate_se"), fit["r_squared"].alias("r_squared"), fit["n"].alias("n_obs"))


#: Metres of change from which a trend counts: fixed value.
VALID_METRES = 15


def is_valid(n_obs: ColumnOrName, rate: ColumnOrName) -> Column:
    """Observations times absolute rate is over 15 m; missing is 0."""
    return F.coalesce(col(n_obs), F.lit(0)) * F.abs(F.coalesce(nan_to_null(rate), F.lit(0.0))) > VALID_METRES


def ambient_change(df: DataFrame, targets: Sequence[datetime], reference: str = "reference_datetime", rate: str = "change_rate") -> DataFrame:
    """A row for each row and target date, with the change of the trend from the reference year to that of the target."""
    for c in (reference, rate):
        if c not in df.columns:
            raise ValueError(f"missing column: {c}")
    dates = F.explode(F.array(*[F.lit(t).cast("timestamp") for t in targets]))
    df = df.withColumn("datetime", dates)
    return df.withColumn("ambient_change_mean", (F.col(rate) * (F.year("datetime") - F.year(reference))).cast("float"))


def projection_statistics(df: DataFrame, mean: str = "ambient_change_mean", std: str = "ambient_change_std", slr: str = "slr_retreat_samples", total: str = "total_change_samples") -> DataFrame:
    """p5, p50, p95 of the samples in each row and the bounds of the trend; no samples give 0 for the retreat and NULL for the total."""
    low, high = normal_bounds(mean, std)
    cols = {"ambient_change_p5": low, "ambient_change_p95": high}
    for q in (5, 50, 95):
        cols[f"slr_retreat_p{q}"] = F.coalesce(array_quantile(slr, q / 100), F.lit(0.0))
        cols[f"total_change_p{q}"] = array_quantile(total, q / 100)
    return df.withColumns({k: c.cast("float") for k, c in cols.items()})


def projected_distance(base: Column, change: Column, buffer: Column, total: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(total)), base + change - F.abs(buffer)))


def project(df: DataFrame, change: ColumnOrName, buffer: ColumnOrName | None = None, kind: str = "point", alongshore: float = 50.0, extend_to: float = 10_000.0, into: str = "geometry") -> DataFrame:
    """df (start, end, reference: points in degrees; utm_epsg) with the future shoreline on its transect.

    The transect is extended in its zone, the reference point measured along it, moved by the change less the buffer and
    held within the transect.  kind point gives that place; rectangle a ring between both places, alongshore metres to
    each side.  NULL for a transect that is longer than extend_to or has no length, and for a rectangle without any.
    Each step is bound by a transform over one element: written into one another they would be copied many times over.
    """
    if kind not in ("point", "rectangle"):
        raise ValueError("kind must be point or rectangle")
    moved = F.lit(0.0) if buffer is None else col(buffer).cast("double")
    state = F.array(F.struct(F.array("start", "end", "reference").alias("g"), col(change).cast("double").alias("change"), moved.alias("buffer"), F.col("utm_epsg").alias("epsg")))

    def struct(s: Column, keep: str, **new: Column) -> Column:
        return F.struct(*[s[k].alias(k) for k in keep.split()], *[c.alias(k) for k, c in new.items()])

    given = "change buffer epsg"
    state = F.transform(state, lambda s: struct(s, given, u=crs.utm_line(s["g"], s["epsg"])))
    state = F.transform(state, lambda s: struct(s, given, a=F.get(s["u"], F.lit(0)), b=F.get(s["u"], F.lit(1)), r=F.get(s["u"], F.lit(2))))
    state = F.transform(state, lambda s: struct(s, f"{given} a b r", n=planar.distance(s["a"], s["b"])))
    state = F.transform(state, lambda s: struct(s, f"{given} a b r", more=F.when((s["n"] <= extend_to) & (s["n"] > 0), (s["n"] - extend_to) / 2)))
    state = F.transform(state, lambda s: struct(s, f"{given} r more", a=planar.shift_point(s["a"], s["b"], s["more"]), b=planar.shift_point(s["b"], s["a"], s["more"])))
    state = F.transform(state, lambda s: struct(s, f"{given} more a b", base=planar.project(s["a"], s["b"], s["r"])))
    state = F.transform(state, lambda s: struct(s, "epsg more a b base", at=projected_distance(s["base"], s["change"], s["buffer"], extend_to)))
    state = F.transform(state, lambda s: struct(s, "epsg more base at", p=planar.shift_point(s["a"], s["b"], s["at"]), q=planar.shift_point(s["a"], s["b"], s["base"])))
    if kind == "point":
        made = F.transform(state, lambda s: F.when(s["more"].isNotNull(), F.get(crs.utm_inverse_line(F.array(s["p"]), s["epsg"]), F.lit(0))))
    else:
        state = F.transform(state, lambda s: struct(s, "epsg more base at", ring=planar.offset_rectangle(s["q"], s["p"], alongshore)))
        made = F.transform(state, lambda s: F.when(s["more"].isNotNull() & (s["at"] != s["base"]), crs.utm_inverse_line(s["ring"], s["epsg"])))
    return df.withColumn(into, F.get(made, F.lit(0)))


def apply_projection(df: DataFrame, kind: str = "point", alongshore: float = 50.0, valid: str = "ambient_change_is_valid") -> DataFrame:
    """geometry of each row's future shoreline from the middle retreat and, where its trend is valid, the mean trend.

    df: start, end, reference, utm_epsg, the columns of projection_statistics and accommodation_buffer; rows without a geometry go.
    """
    stats = projection_statistics(df)
    change = F.col("slr_retreat_p50").cast("double") + F.when(F.col(valid), F.coalesce(nan_to_null("ambient_change_mean"), F.lit(0.0))).otherwise(0.0)
    return project(stats, change, "accommodation_buffer", kind, alongshore).where(F.col("geometry").isNotNull())


def transects(coastlines: DataFrame, length: float, spacing: float, smooth: float = 0.001) -> DataFrame:
    """Transects across coastlines (coast_id, line: points in the zone's metres, utm_epsg): id, longitude and latitude of the origin, bearing and line.

    A row for each coastline becomes a row for each origin inside the task that holds it; nothing is shuffled.
    """
    df = coastlines.withColumn("__m", planar.measures("line")).withColumn("__l", F.try_element_at("__m", F.lit(-1)))
    df = df.withColumn("__o", F.explode(planar.transect_origins("__l", spacing)))
    # The three places come as one array, so that their expression stands in the plan once.
    at = F.transform(F.array(F.lit(-smooth), F.lit(0.0), F.lit(smooth)), lambda d: planar.interpolate("line", F.col("__o") + d, "__m"))
    df = df.withColumn("__at", at).withColumns({k: F.get("__at", F.lit(n)) for n, k in enumerate(("__b", "__p", "__a"))})
    df = df.withColumn("transect", planar.transect(F.col("__b"), F.col("__p"), F.col("__a"), length))
    place = crs.utm_inverse(F.col("__p")["x"], F.col("__p")["y"], F.col("utm_epsg"))
    df = df.withColumns({"__w": place, "bearing": planar.bearing(planar.first("transect"), planar.last("transect"))})
    name = F.concat(F.col("coast_id").cast("string"), F.lit("tr"), F.floor("__o").cast("string"))
    return df.select(name.alias("transect_id"), "coast_id", F.col("__w")["x"].alias("lon"), F.col("__w")["y"].alias("lat"), "bearing", "transect", "utm_epsg")
