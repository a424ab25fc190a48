"""Selection of image items: least cloudy per time bin and group, a quota by mean cloud cover, backfill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Mean cloud cover up to which so many items of a group are taken: fixed values.
QUOTAS = {10: 10, 40: 20, 100: 30}


def quota(cloud: Column, quotas: Mapping[int, int] = QUOTAS) -> Column:
    out = F.lit(max(quotas.values()))
    for limit in sorted(quotas, reverse=True):
        out = F.when(cloud <= limit, F.lit(quotas[limit])).otherwise(out)
    return out


def groups_of(items: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """items with a synthetic group: each key its own while they are few, else a hash of the key (the same in every run)."""
    keys = items.select(*by).distinct().count()
    if keys <= most:
        named = items.select(*by).distinct().withColumn("synthetic_group", (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))  # at most `most` rows
        return items.join(F.broadcast(named), list(by))
    return items.withColumn("synthetic_group", F.pmod(F.xxhash64(*by), F.lit(most)))


def best_per_bin(items: DataFrame, group: str, days: int = 5, when: str = "datetime", cloud: str = "cloud_cover", key: str = "id") -> DataFrame:
    """The least cloudy item of each group in each bin of so many days, bins counted from 1970-01-01."""
    b = F.floor(F.unix_seconds(F.col(when).cast("timestamp")) / (days * 86400))
    w = Window.partitionBy(group, "__bin").orderBy(F.col(cloud).asc_nulls_last(), key)
    return items.withColumn("__bin", b).withColumn("__r", F.row_number().over(w)).where("__r = 1").withColumn("time_bin", F.timestamp_seconds(F.col("__bin") * (days * 86400))).drop("__r", "__bin")


def top_per_group(items: DataFrame, group: str, n: int | Column, cloud: str = "cloud_cover", key: str = "id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(cloud).asc_nulls_last(), key)
    return items.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def summer_only(items: DataFrame, when: str = "datetime") -> DataFrame:
    """July to September where everything lies above 60 degrees north, January to March where below 60 south, else all."""
    lat = items.agg(F.min("ymin").alias("low"), F.max("ymax").alias("high")).first()
    months = (7, 8, 9) if lat["low"] is not None and lat["low"] > 60 else (1, 2, 3) if lat["high"] is not None and lat["high"] < -60 else None
    return items.where(F.month(when).isin(*months)) if months else items


def select_items(items: DataFrame, by: Sequence[str], days: int = 5, groups: int = 4, most: int = 30, quotas: Mapping[int, int] = QUOTAS, only_summer: bool = False, when: str = "datetime", cloud: str = "cloud_cover", key: str = "id") -> DataFrame:
    """Up to `most` items: the quota of each group, filled up with the least cloudy of the rest, least cloudy first."""
    df = summer_only(items, when) if only_summer else items
    df = best_per_bin(groups_of(df, by, groups), "synthetic_group", days, when, cloud, key)
    mean = df.agg(F.avg(cloud).alias("m"))
    w = Window.partitionBy("synthetic_group").orderBy(F.col(cloud).asc_nulls_last(), key)
    ranked = df.withColumn("__r", F.row_number().over(w)).crossJoin(F.broadcast(mean))  # one row
    late = (F.col("__r") > quota(F.col("m"), quotas)).cast("int")
    # Quota first, then the others; the best `most` of these by cloud cover.
    chosen = ranked.withColumn("__late", late).orderBy("__late", F.col(cloud).asc_nulls_last(), key).limit(max(most, groups * max(quotas.values())))
    n_in = F.count_if(F.col("__late") == 0).over(Window.partitionBy(F.lit(1)))
    order = F.row_number().over(Window.partitionBy("__late").orderBy(F.col(cloud).asc_nulls_last(), key))
    filled = chosen.withColumn("__in", n_in).withColumn("__o", order).where((F.col("__late") == 0) | (F.col("__o") <= F.lit(most) - F.col("__in")))
    return filled.orderBy(F.col(cloud).asc_nulls_last(), key).limit(most).drop("__r", "m", "__late", "__in", "__o")
