"""Trends, projections and forecast metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import crs, metrics, planar
from tidemark.functions.planar import point
from tidemark.functions.samples import array_quantile, normal_bounds
from tidemark.functions.trends import ols
from tidemark.operators import series as ops
from tidemark.plans import fixtures as fx
from tidemark.plans import query
from tidemark.plans.fixtures import q, r, with_views

_FIT = "regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n"


@query(
    f"""{with_views('series')}, o AS (SELECT transect_id, CAST(year(datetime) AS DOUBLE) AS x, chainage AS y FROM series WHERE obs_is_primary),
f AS (SELECT transect_id, {_FIT} FROM o GROUP BY transect_id)
SELECT transect_id, {q('CASE WHEN n >= 3 THEN slope END')} AS change_rate, {q('CASE WHEN n >= 3 THEN icpt END', 4)} AS change_intercept,
  {q('CASE WHEN n >= 3 THEN sqrt(greatest(0, syy - slope * sxy) / (n - 2) / sxx) END')} AS change_rate_se, {q('CASE WHEN n >= 3 THEN r2 END')} AS r_squared, n AS n_obs FROM f"""
)
def ols_trend_by_transect(spark, d):
    t = ops.trend(fx.series(spark, d), "transect_id", "datetime", "chainage")
    return t.select("transect_id", r("change_rate").alias("change_rate"), r("change_intercept", 4).alias("change_intercept"), r("change_rate_se").alias("change_rate_se"), r("r_squared").alias("r_squared"), "n_obs")


@query(
    f"""WITH o AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT flag, {_FIT} FROM o GROUP BY flag)
SELECT flag, {q('slope', 4)} AS slope, {q('icpt', 3)} AS intercept, {q('sqrt((syy - slope * sxy) / (n - 2) / sxx)')} AS slope_se, {q('r2')} AS r_squared, n FROM f"""
)
def ols_fit_full(spark, d):
    f = ols("l_quantity", "l_extendedprice")
    t = fx.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(*[c.alias(k) for k, c in f.items()])
    return t.select("flag", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), r("slope_se").alias("slope_se"), r("r_squared").alias("r_squared"), "n")


@query(f"{with_views('transects')} SELECT id, (id % 40) * abs(rate) > 15 AS valid FROM transects")
def change_validity(spark, d):
    return fx.transects(spark, d).select("id", ops.is_valid(F.col("id") % 40, "rate").alias("valid"))


@query(
    f"""{with_views('transects')}, y AS (SELECT unnest([2050, 2100]) AS year) SELECT id, make_timestamp(year, 1, 1, 0, 0, 0) AS datetime, {q('rate * (year - 2020)', 2)} AS ambient_change_mean FROM transects, y"""
)
def ambient_change_projection(spark, d):
    t = fx.transects(spark, d).withColumn("reference_datetime", F.to_timestamp(F.lit("2020-06-01")))
    out = ops.ambient_change(t, [datetime(2050, 1, 1), datetime(2100, 1, 1)], rate="rate")
    return out.select("id", "datetime", r(F.col("rate") * (F.year("datetime") - 2020), 2).alias("ambient_change_mean"))


@query(
    f"""WITH s AS (SELECT vec_id, list_sort(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS s FROM embeddings)
SELECT vec_id, {q('s[4] + (s[5] - s[4]) * 15e-2')} AS p5, {q('s[32] + (s[33] - s[32]) * 5e-1')} AS p50, {q('s[60] + (s[61] - s[60]) * 85e-2')} AS p95 FROM s"""
)
def sample_quantiles(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", *[r(array_quantile("embedding", p / 100)).alias(f"p{p}") for p in (5, 50, 95)])


@query(f"{with_views('transects')} SELECT id, {q('rate - abs(lat) / 50 * 16448536269514729e-16')} AS p5, {q('rate + abs(lat) / 50 * 16448536269514729e-16')} AS p95 FROM transects")
def normal_bounds_of_change(spark, d):
    low, high = normal_bounds("rate", F.abs("lat") / 50)
    return fx.transects(spark, d).select("id", r(low).alias("p5"), r(high).alias("p95"))


def _projection_input(spark, d):
    t = fx.transects(spark, d).where(F.abs("lat") < 70).withColumn("utm_epsg", crs.utm_epsg("lon", "lat"))
    near = lambda dx, dy: point(F.col("lon") + dx, F.col("lat") + dy)
    t = t.withColumns({"start": near(-0.002, -0.004), "end": near(0.002, 0.004), "reference": near(0.0005, 0.001)})
    return fx.spread(t.select("id", "rate", "start", "end", "reference", "utm_epsg"))


def _lit(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _series(coefficients, base: str, f: str, g: str, sign: str) -> str:
    return f"{base} {sign} " + f" {sign} ".join(f"{_lit(c)} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(coefficients, 1))


_K, _E = _lit(crs.SCALE * crs.RECTIFYING), _lit(crs.ECCENTRICITY)
_SOUTH = "(CASE WHEN lat < 0 THEN 1e7 ELSE 0e0 END)"


def _inverse(source: str) -> str:
    """CTEs from `source` (id, k, x, y, zone, lat) to `back` (id, k, lon, lat)."""
    steps = [f"i1 AS (SELECT id, k, zone, (y - {_SOUTH}) / {_K} AS xi, (x - 5e5) / {_K} AS eta FROM {source})"]
    steps.append(f"i2 AS (SELECT id, k, zone, {_series(crs.BETA, 'xi', 'sin', 'cosh', '-')} AS n, {_series(crs.BETA, 'eta', 'cos', 'sinh', '-')} AS e FROM i1)")
    steps.append("j0 AS (SELECT id, k, zone, atanh(sin(n) / cosh(e)) AS c, asin(sin(n) / cosh(e)) AS phi, degrees(atan2(sinh(e), cos(n))) AS away FROM i2)")
    steps += [f"j{n + 1} AS (SELECT id, k, zone, c, away, atan(sinh(c + {_E} * atanh({_E} * sin(phi)))) AS phi FROM j{n})" for n in range(6)]
    return ",\n".join([*steps, "back AS (SELECT id, k, away + zone * 6 - 183 AS lon, degrees(phi) AS lat FROM j6)"])


def _projected(buffer: str) -> str:
    """CTEs up to `m` (id, zone, lat, extended ends a and b, length d, base and the moved place along it)."""
    zone = "CAST((CAST(floor((lon + 180) / 6) AS INT) % 60 + 60) % 60 + 1 AS INT)"
    places = "(VALUES (0, -2e-3, -4e-3), (1, 2e-3, 4e-3), (2, 5e-4, 1e-3)) AS v(k, dx, dy)"
    return f"""{with_views("transects")},
g AS (SELECT id, rate, lat, k, lon + dx AS x, lat + dy AS y, {zone} AS zone FROM transects, {places} WHERE abs(lat) < 70),
u1 AS (SELECT *, radians(x - (zone * 6 - 183)) AS away, atanh(sin(radians(y))) - {_E} * atanh({_E} * sin(radians(y))) AS c FROM g),
u2 AS (SELECT *, atan2(sinh(c), cos(away)) AS xi, atanh(sin(away) / cosh(c)) AS eta FROM u1),
u3 AS (SELECT id, rate, lat, zone, k, ({_series(crs.ALPHA, 'eta', 'cos', 'sinh', '+')}) * {_K} + 5e5 AS x, ({_series(crs.ALPHA, 'xi', 'sin', 'cosh', '+')}) * {_K} + {_SOUTH} AS y FROM u2),
w AS (SELECT id, rate, lat, zone, {", ".join(f"max({c}) FILTER (WHERE k = {k}) AS {n}{c}" for k, n in enumerate("aer") for c in "xy")} FROM u3 GROUP BY id, rate, lat, zone),
n AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS n FROM (SELECT * RENAME (ex AS bx, ey AS by_) FROM w)),
x AS (SELECT id, rate, lat, zone, rx, ry, ax + (bx - ax) * (n - 1e4) / 2 / n AS ax, ay + (by_ - ay) * (n - 1e4) / 2 / n AS ay, bx + (ax - bx) * (n - 1e4) / 2 / n AS bx, by_ + (ay - by_) * (n - 1e4) / 2 / n AS cy FROM n),
d AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)) AS d FROM x),
b AS (SELECT *, greatest(0e0, least(1e0, ((rx - ax) * (bx - ax) + (ry - ay) * (cy - ay)) / (d * d))) * d AS base FROM d),
m AS (SELECT *, greatest(0e0, least(1e4, base + rate * 10 - {buffer})) AS moved FROM b)"""


_ALONG = "ax + (bx - ax) * least(1e0, {0} / d) + {1} * (cy - ay) / d * s AS x, ay + (cy - ay) * least(1e0, {0} / d) - {1} * (bx - ax) / d * s AS y"


@query(f"{_projected('5e0')}, p AS (SELECT id, 0 AS k, zone, lat, {_ALONG.format('moved', '0e0').replace(' * s', '')} FROM m),\n{_inverse('p')} SELECT id, {q('lon')} AS lon, {q('lat')} AS lat FROM back")
def projected_point(spark, d):
    p = ops.project(_projection_input(spark, d), F.col("rate") * 10, F.lit(5.0))
    return p.select("id", r("geometry.x").alias("lon"), r("geometry.y").alias("lat"))


_CORNERS = f"SELECT id, k, zone, lat, {_ALONG.format('(CASE WHEN k < 2 THEN base ELSE moved END)', '5e1')} FROM m, (VALUES (0, 1), (1, -1), (2, 1), (3, -1)) AS v(k, s) WHERE moved <> base"


@query(f"{_projected('0e0')}, p AS ({_CORNERS}),\n{_inverse('p')}, h AS (SELECT id, {q('min(lon)')} AS xmin, {q('min(lat)')} AS ymin, {q('max(lon)')} AS xmax, {q('max(lat)')} AS ymax FROM back GROUP BY id) SELECT m.id, xmin, ymin, xmax, ymax FROM m LEFT JOIN h ON h.id = m.id")
def projected_rectangle(spark, d):
    p = ops.project(_projection_input(spark, d), F.col("rate") * 10, kind="rectangle").select("id", planar.bounds("geometry").alias("b"))
    return p.select("id", *[r(f"b.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


_TERMS = f"""{with_views('forecast')},
w AS (SELECT *, actual AS a, predicted AS p, actual - predicted AS e, actual - lag(actual) OVER s AS nv, CASE WHEN lag(actual) OVER s IS NOT NULL THEN CAST(sign(actual - lag(actual) OVER s) = sign(predicted - lag(predicted) OVER s) AS INT) END AS hit,
  abs(actual - avg(actual) OVER (PARTITION BY user_id)) AS off FROM forecast WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, e / (a + 1e-10) AS pe, 2 * abs(e) / (abs(a) + abs(p) + 1e-10) AS sape, e / (nv + 1e-10) AS rel, abs(e) / (abs(e) + abs(nv) + 1e-10) AS bnd FROM w)"""


def _spread(c: str) -> str:
    return f"sqrt((var_pop({c}) * count({c}) + count({c}) * power(avg({c}) - avg(abs({c})), 2)) / nullif(count({c}) - 1, 0))"


#: name, SQL over the terms; values that may be huge are compared with fewer digits.
_SQL_METRICS = {
    "mse": "avg(e * e)", "rmse": "sqrt(avg(e * e))", "nrmse": "sqrt(avg(e * e)) / nullif(max(a) - min(a), 0)", "me": "avg(e)", "mae": "avg(abs(e))", "mad": "avg(abs(e))",
    "gmae": "CASE WHEN count(*) FILTER (WHERE e = 0) > 0 THEN 0 ELSE exp(avg(ln(abs(nullif(e, 0))))) END", "mdae": "median(abs(e))",
    "mpe": "avg(pe)", "mape": "avg(abs(pe))", "mdape": "median(abs(pe))", "smape": "avg(sape)", "smdape": "median(sape)", "maape": "avg(atan(abs(pe)))", "rmspe": "sqrt(avg(pe * pe))", "rmdspe": "sqrt(median(pe * pe))",
    "std_ae": _spread("e"), "std_ape": _spread("pe"),
    "mase": "avg(abs(e)) / nullif(avg(abs(nv)), 0)", "rmsse": "sqrt(avg(e * e)) / nullif(avg(abs(nv)), 0)", "inrse": "sqrt(sum(e * e) / nullif(var_pop(a) * count(a), 0))", "rrse": "sqrt(sum(e * e) / nullif(var_pop(a) * count(a), 0))", "rae": "sum(abs(e)) / (sum(off) + 1e-10)",
    "mre": "avg(rel)", "mrae": "avg(abs(rel))", "mdrae": "median(abs(rel))", "gmrae": "CASE WHEN count(*) FILTER (WHERE rel = 0) > 0 THEN 0 ELSE exp(avg(ln(abs(nullif(rel, 0))))) END",
    "mbrae": "avg(bnd)", "umbrae": "avg(bnd) / nullif(1 - avg(bnd), 0)", "mda": "avg(hit)",
}
_GROUPS = {
    "basic": ("mse", "rmse", "nrmse", "me", "mae", "mad", "gmae", "mdae", "std_ae"),
    "percentage": ("mpe", "mape", "mdape", "smape", "smdape", "maape", "rmspe", "rmdspe", "std_ape"),
    "scaled": ("mase", "rmsse", "inrse", "rrse", "rae"),
    "relative": ("mre", "mrae", "mdrae", "gmrae"),
    "bounded": ("mbrae", "umbrae"),
    "directional": ("mda",),
}


for _name, _chosen in _GROUPS.items():

    @query(f"{_TERMS} SELECT user_id, {', '.join(f'{q(_SQL_METRICS[n], 4)} AS {n}' for n in _chosen)} FROM t GROUP BY user_id", name=f"metrics_{_name}")
    def _metrics(spark, d, chosen=_chosen):
        out = metrics.evaluate(fx.forecast(spark, d), "actual", "predicted", ["user_id"], ["ts", "event_id"], chosen)
        return out.select("user_id", *[r(n, 4).alias(n) for n in chosen])
