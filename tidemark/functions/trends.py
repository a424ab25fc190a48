"""Ordinary least squares as aggregate expressions, in one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, col


def ols(x: ColumnOrName, y: ColumnOrName) -> dict[str, Column]:
    """intercept, slope, slope_se, r_squared and n; all NULL under three pairs.

    Equal x: slope 0 and the mean as intercept, no standard error.  Equal y: no R squared.
    """
    x, y = col(x).cast("double"), col(y).cast("double")
    n, sxx, syy, sxy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    enough = n >= 3
    slope = F.coalesce(F.try_divide(sxy, F.nullif(sxx, F.lit(0.0))), F.lit(0.0))
    rest = F.greatest(F.lit(0.0), syy - slope * sxy)
    return {
        "intercept": F.when(enough, F.regr_avgy(y, x) - slope * F.regr_avgx(y, x)),
        "slope": F.when(enough, slope),
        "slope_se": F.when(enough & (sxx > 0), F.sqrt(F.try_divide(F.try_divide(rest, F.nullif(n - 2, F.lit(0))), F.nullif(sxx, F.lit(0.0))))),
        "r_squared": F.when(enough & (syy > 0), 1 - F.try_divide(rest, F.nullif(syy, F.lit(0.0)))),
        "n": n,
    }
