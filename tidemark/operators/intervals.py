"""As-of and interval joins that shuffle on keys and bins, never as a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], when: str, columns: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """left with columns of the last row of right of its keys at or before its time (NULL without one, or beyond the tolerance in seconds).

    Both sides go through one shuffle and one sort; the last value is carried along by a window, so the sides never multiply.
    """
    none = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
    a = left.select(*keys, F.col(when).alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__row"), F.lit(None).cast(right.schema[when].dataType).alias("__at"), *none)
    b = right.select(*keys, F.col(when).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(when).alias("__at"), *columns)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("__side") == 0, F.struct("__at", *columns)), ignorenulls=True).over(w)
    both = a.unionByName(b).withColumn("__held", held).where("__side = 1")
    near = F.lit(True) if tolerance is None else F.col("__t").cast("timestamp").cast("double") - F.col("__held.__at").cast("timestamp").cast("double") <= tolerance
    return both.select("__row.*", *[F.when(near, F.col(f"__held.{c}")).alias(c) for c in columns])


def within_intervals(points: DataFrame, spans: DataFrame, when: str, start: str, end: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point and every span [start, end) of its keys that holds it: spans are filed under the bins of that width (in seconds) which they touch."""
    bin_of = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") / width)
    p = points.withColumn("__bin", bin_of(when))
    s = spans.withColumn("__bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    return p.join(s, [*keys, "__bin"]).where((F.col(when) >= F.col(start)) & (F.col(when) < F.col(end))).drop("__bin")
