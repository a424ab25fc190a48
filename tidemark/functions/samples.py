"""Quantiles of arrays inside a row, and bounds of a normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, col

#: 95 % quantile of the standard normal distribution: fixed value.
Z95 = 1.6448536269514729


def array_quantile(values: ColumnOrName, q: float) -> Column:
    """Linear quantile of an array; NULL for an empty one."""
    s = F.array_sort(F.transform(col(values), lambda v: v.cast("double")))
    at = (F.size(s) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.ceil(at).cast("int"))
    return a + (b - a) * (at - low)


def normal_bounds(mean: ColumnOrName, std: ColumnOrName) -> tuple[Column, Column]:
    """5 % and 95 % quantiles; NULL where the deviation is NULL or NaN."""
    spread = F.nanvl(col(std).cast("double"), F.lit(None).cast("double")) * Z95
    return col(mean) - spread, col(mean) + spread


def nan_to_null(c: ColumnOrName) -> Column:
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
