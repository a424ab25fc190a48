"""Spatial joins that shuffle on tiles, never as a cross join.

Each side is filed under the tiles that it touches; rows meet under a tile by an equi-join, which Spark can split where
a tile is hot, and a pair counts only in its reference tile (the one of the lower left corner of what both share), so no
distinct is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_EDGES = ("xmin", "ymin", "xmax", "ymax")


def _cells(size: float) -> Column:
    xs = F.sequence(F.floor(F.col("xmin") / size), F.floor(F.col("xmax") / size))
    ys = F.sequence(F.floor(F.col("ymin") / size), F.floor(F.col("ymax") / size))
    return F.explode(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy"))))))


def box_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float = 5.0) -> DataFrame:
    """(a_id, b_id) of every pair of boxes that meet, edges included; cell: side of a tile, about the size of the larger boxes."""
    left = a.select(F.col(a_id), *[F.col(c).alias(f"a_{c}") for c in _EDGES], *_EDGES).withColumn("__c", _cells(cell)).drop(*_EDGES)
    right = b.select(F.col(b_id), *[F.col(c).alias(f"b_{c}") for c in _EDGES], *_EDGES).withColumn("__c", _cells(cell)).drop(*_EDGES)
    left = left.select("*", "__c.*").drop("__c")
    right = right.select("*", "__c.*").drop("__c")
    pairs = left.join(right, ["cx", "cy"])
    meets = (F.col("a_xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("a_xmax")) & (F.col("a_ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("a_ymax"))
    reference = (F.floor(F.greatest("a_xmin", "b_xmin") / cell) == F.col("cx")) & (F.floor(F.greatest("a_ymin", "b_ymin") / cell) == F.col("cy"))
    return pairs.where(meets & reference).select(a_id, b_id, *[f"a_{c}" for c in _EDGES], *[f"b_{c}" for c in _EDGES])


def overlay_boxes(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float = 5.0) -> DataFrame:
    """The shared box of every pair, with its area; touching edges share no area and are left out."""
    p = box_join(a, b, a_id, b_id, cell).select(
        a_id, b_id, F.greatest("a_xmin", "b_xmin").alias("xmin"), F.greatest("a_ymin", "b_ymin").alias("ymin"), F.least("a_xmax", "b_xmax").alias("xmax"), F.least("a_ymax", "b_ymax").alias("ymax")
    )
    return p.withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).where("area > 0")


def count_within(areas: DataFrame, things: DataFrame, area_id: str, thing_id: str, cell: float = 5.0) -> DataFrame:
    """areas with n: things that meet each; 0 where none does, NULL where the area has no bounds."""
    n = box_join(areas.where(F.col("xmin").isNotNull()), things, area_id, thing_id, cell).groupBy(area_id).agg(F.count(F.lit(1)).alias("n"))
    joined = areas.join(n, area_id, "left")
    return joined.withColumn("n", F.when(F.col("xmin").isNotNull(), F.coalesce("n", F.lit(0).cast("long"))))


def nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, most: float, columns: Sequence[str] = ()) -> DataFrame:
    """a with columns of the nearest row of b within a distance of `most` (x and y are planar), its id and the distance; the smallest id wins a tie, and rows without a neighbour get NULL.

    Of rows of b at one place only the smallest id can win, so the others go first.  The rest is filed under its cell of
    side `most` and the eight around it, as one list for each cell: a row of a meets the list of its own cell and takes the
    least of it, so that pairs are neither written nor sorted.  The lists are merged with a and not broadcast, as their
    size is not known before.
    """
    places = b.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.min_by(F.struct(b_id, *columns), b_id).alias("row"))
    around = F.explode(F.array(*[F.struct((F.floor(F.col("x") / most) + i).alias("__cx"), (F.floor(F.col("y") / most) + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    filed = places.select("x", "y", "row", around.alias("c")).groupBy("c.__cx", "c.__cy").agg(F.collect_list(F.struct("x", "y", "row")).alias("__near"))
    asks = a.withColumns({"__cx": F.floor(F.col("x") / most), "__cy": F.floor(F.col("y") / most)})

    def candidate(p: Column, k: Column) -> Column:
        dx, dy = p["x"] - F.col("x"), p["y"] - F.col("y")
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("distance"), p["row"][b_id].alias("id"), k.alias("k"))

    best = asks.join(filed.hint("merge"), ["__cx", "__cy"], "left").withColumn("__best", F.array_min(F.transform("__near", candidate)))
    best = best.withColumn("__best", F.when(F.col("__best")["distance"] <= most, F.col("__best")))
    row = F.get("__near", F.col("__best")["k"])["row"]
    return best.select(*a.columns, row[b_id].alias(b_id), F.col("__best")["distance"].alias("distance"), *[row[c].alias(c) for c in columns])


def nearest_one(points: DataFrame, x: float, y: float, k: int = 1, key: str = "id") -> DataFrame:
    """The k rows nearest to one place: each task keeps k rows, so nothing is sorted as a whole."""
    dx, dy = F.col("x") - x, F.col("y") - y
    return points.withColumn("distance", F.sqrt(dx * dx + dy * dy)).orderBy("distance", key).limit(k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in a stated order; window group limit keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
