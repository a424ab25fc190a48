"""Thirty forecast error metrics as aggregate expressions.

prepare() adds the per-row terms (the lagged value and the group mean need a window); every metric is then one
aggregate expression, so any choice of them is one pass over one shuffle.  NULL or NaN pairs are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.samples import nan_to_null

#: Keeps denominators from zero: fixed value.
EPSILON = 1e-10


def prepare(df: DataFrame, actual: str, predicted: str, keys: Sequence[str], order: Sequence[str], seasonality: int = 1) -> DataFrame:
    """keys and the terms of each pair: a, p, e, pe, naive (error of the value `seasonality` earlier), rel, bnd, hit, off (distance from the group mean)."""
    rows = df.select(*keys, *order, nan_to_null(actual).alias("a"), nan_to_null(predicted).alias("p")).where("a is not null and p is not null")
    whole = Window.partitionBy(*keys)
    series = whole.orderBy(*order)
    before, before_p = F.lag("a", seasonality).over(series), F.lag("p", 1).over(series)
    rows = rows.select(
        *keys, "a", "p", (F.col("a") - F.col("p")).alias("e"), (F.col("a") - before).alias("naive"),
        (F.signum(F.col("a") - F.lag("a", 1).over(series)) == F.signum(F.col("p") - before_p)).cast("double").alias("hit"), F.abs(F.col("a") - F.avg("a").over(whole)).alias("off"),
    )
    e, naive = F.col("e"), F.col("naive")
    return rows.withColumns(
        {
            "pe": F.try_divide(e, F.col("a") + EPSILON),
            "sape": 2.0 * F.abs(e) / (F.abs("a") + F.abs("p") + EPSILON),
            "rel": F.try_divide(e, naive + EPSILON),
            "bnd": F.abs(e) / (F.abs(e) + F.abs(naive) + EPSILON),
        }
    )


def _mean(c: str, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.avg(f(F.col(c)))


def _square(x: Column) -> Column:
    return x * x


def _geometric(c: str) -> Column:
    return F.when(F.count_if(F.col(c) == 0) > 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.abs(F.nullif(F.col(c), F.lit(0.0)))))))


def _spread(c: str) -> Column:
    """Deviation of a signed error around the mean of its absolute value, with n - 1."""
    n, gap = F.count(c), F.avg(c) - F.avg(F.abs(c))
    return F.sqrt(F.try_divide(F.var_pop(c) * n + n * gap * gap, F.nullif(n - 1, F.lit(0))))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def metrics() -> dict[str, Column]:
    """Name to aggregate expression over the terms of prepare()."""
    mae, mse, naive, bounded = _mean("e", F.abs), _mean("e", _square), _mean("naive", F.abs), F.avg("bnd")
    inrse = F.sqrt(_ratio(F.sum(F.col("e") * F.col("e")), F.var_pop("a") * F.count("a")))
    return {
        "mse": mse,
        "rmse": F.sqrt(mse),
        "nrmse": _ratio(F.sqrt(mse), F.max("a") - F.min("a")),
        "me": F.avg("e"),
        "mae": mae,
        "mad": mae,
        "gmae": _geometric("e"),
        "mdae": F.median(F.abs("e")),
        "mpe": F.avg("pe"),
        "mape": _mean("pe", F.abs),
        "mdape": F.median(F.abs("pe")),
        "smape": F.avg("sape"),
        "smdape": F.median("sape"),
        "maape": F.avg(F.atan(F.abs("pe"))),
        "mase": _ratio(mae, naive),
        "std_ae": _spread("e"),
        "std_ape": _spread("pe"),
        "rmspe": F.sqrt(_mean("pe", _square)),
        "rmdspe": F.sqrt(F.median(F.col("pe") * F.col("pe"))),
        "rmsse": _ratio(F.sqrt(mse), naive),
        "inrse": inrse,
        "rrse": inrse,
        "mre": F.avg("rel"),
        "rae": F.sum(F.abs("e")) / (F.sum("off") + EPSILON),
        "mrae": _mean("rel", F.abs),
        "mdrae": F.median(F.abs("rel")),
        "gmrae": _geometric("rel"),
        "mbrae": bounded,
        "umbrae": _ratio(bounded, 1 - bounded),
        "mda": F.avg("hit"),
    }


def evaluate(df: DataFrame, actual: str, predicted: str, keys: Sequence[str], order: Sequence[str], names: Sequence[str] = ("mae", "mse", "smape", "umbrae"), seasonality: int = 1) -> DataFrame:
    """The metrics of those names for each group; an unknown name is a NULL column."""
    known = metrics()
    terms = prepare(df, actual, predicted, keys, order, seasonality)
    return terms.groupBy(*keys).agg(*[known.get(n, F.first(F.lit(None).cast("double"))).alias(n) for n in names])
