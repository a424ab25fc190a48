"""Work logs as tables: merging updates, resetting, priorities and drawing work.

A log has id, status, bands (array), retries, priority, datetime, message.  An update is a merge of a table of events
into the log: events of an id are folded in order inside one aggregation, so any number of them costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING, PROCESSING, SUCCESS, FAILED, PARTLY, SKIPPED = "Pending", "Processing", "Success", "Failed", "Partly", "Skipped"
DDL = "id string, status string, bands array<string>, retries int, priority int, datetime string, message string"


def create(ids: DataFrame) -> DataFrame:
    """A new log over distinct ids."""
    return ids.select(F.col("id").cast("string").alias("id")).distinct().select(
        "id", F.lit(PENDING).alias("status"), F.array().cast("array<string>").alias("bands"), F.lit(0).alias("retries"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("datetime"), F.lit("").alias("message")
    )


def missing(log: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").cast("string")).distinct().join(log, "id", "left_anti")


def validated(log: DataFrame, ids: DataFrame, add_missing: bool = False) -> DataFrame:
    """log with the missing ids added, or an error that names some of them."""
    lacks = missing(log, ids)
    if add_missing:
        return log.unionByName(create(lacks))
    if some := [r["id"] for r in lacks.limit(5).collect()]:
        raise ValueError(f"ids missing in the log: {some}")
    return log


def assign_priority(log: DataFrame, priorities: DataFrame) -> DataFrame:
    p = priorities.select("id", F.col("priority").alias("__p"))
    return log.join(p, "id", "left").withColumn("priority", F.coalesce("__p", "priority")).drop("__p")


def completeness(bands: Column, required: Sequence[str]) -> tuple[Column, Column]:
    """Status and message of a tile with these bands."""
    lacks = F.array_sort(F.array_except(F.array(*[F.lit(b) for b in required]), bands))
    done = F.size(lacks) == 0
    return F.when(done, SUCCESS).otherwise(PARTLY), F.when(done, "All bands processed.").otherwise(F.concat(F.lit("Missing bands: "), F.array_join(lacks, ", ")))


def merge(log: DataFrame, events: DataFrame) -> DataFrame:
    """log after events (id, seq, status, message, datetime, band): last one wins, bands add up, a failure counts a retry, a success sets retries to 0; events of unknown ids are left out."""
    e = F.struct("seq", "status", "message", "datetime")
    folded = events.groupBy("id").agg(F.array_sort(F.collect_list(e)).alias("__e"), F.array_sort(F.collect_set("band")).alias("__b"))
    joined = log.join(folded, "id", "left")
    bad = F.array(F.lit(FAILED), F.lit(PARTLY))
    retries = F.aggregate("__e", F.col("retries"), lambda n, x: F.when(F.array_contains(bad, x["status"]), n + 1).when(x["status"] == SUCCESS, 0).otherwise(n))
    last = F.try_element_at("__e", F.lit(-1))
    joined = joined.withColumns({"retries": F.coalesce(retries, "retries"), "bands": F.array_sort(F.array_union(F.coalesce("bands", F.array().cast("array<string>")), F.coalesce("__b", F.array().cast("array<string>"))))})
    said = F.when(F.array_contains(bad, last["status"]), F.format_string("%s (retry count: %d)", last["message"], F.col("retries"))).otherwise(last["message"])
    return joined.withColumns({"message": F.coalesce(said, "message"), "status": F.coalesce(last["status"], "status"), "datetime": F.coalesce(last["datetime"], "datetime")}).drop("__e", "__b")


def reset(log: DataFrame, statuses: Sequence[str] = (PROCESSING,)) -> DataFrame:
    back = F.col("status").isin(*statuses)
    return log.withColumns({"message": F.when(back, "").otherwise(F.col("message")), "status": F.when(back, PENDING).otherwise(F.col("status"))})


def _open(log: DataFrame, statuses: Sequence[str], min_priority: int | None, max_retries: int | None) -> DataFrame:
    df = log.where(F.col("status").isin(*statuses))
    if min_priority is None:  # the highest there is
        top = df.agg(F.max("priority").alias("__top"))
        df = df.join(F.broadcast(top), F.col("priority") >= F.col("__top")).drop("__top")  # one row
    else:
        df = df.where(F.col("priority") >= min_priority)
    return df if max_retries is None else df.where(F.col("retries") < max_retries)


def draw(log: DataFrame, n: int, statuses: Sequence[str] = (PENDING,), min_priority: int | None = None, max_retries: int | None = None, by_priority: bool = True, seed: int = 0) -> DataFrame:
    """Up to n rows, the highest priority first, in an order that a hash of id and seed shuffles within a priority."""
    order = [F.xxhash64("id", F.lit(seed)), "id"]
    df = _open(log, statuses, min_priority, max_retries)
    return df.orderBy(*([F.col("priority").desc()] if by_priority else []), *order).limit(n)


def draw_in_order(log: DataFrame, n: int, statuses: Sequence[str] = (PENDING,), min_priority: int | None = None, max_retries: int | None = None, order: str = "id") -> DataFrame:
    return _open(log, statuses, min_priority, max_retries).orderBy(order).limit(n)


def to_process(log: DataFrame, statuses: Sequence[str] = (PENDING,), min_priority: int | None = None) -> DataFrame:
    return _open(log, statuses, min_priority, None).agg(F.count(F.lit(1)).alias("n"))


def from_files(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """id and its bands, from paths and a pattern whose first group is the id and whose second, if any, is the band; other paths are left out."""
    groups = pattern.count("(") - pattern.count("(?:") - pattern.count(r"\(")
    ids = F.regexp_extract(path, pattern, 1)
    band = F.nullif(F.regexp_extract(path, pattern, 2), F.lit("")) if groups > 1 else F.lit(None).cast("string")
    return files.select(ids.alias("id"), band.alias("band")).where("id <> ''").groupBy("id").agg(F.array_sort(F.collect_set("band")).alias("bands"))


def update_from_files(log: DataFrame, found: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    f = found.select("id", F.col("bands").alias("__b"))
    df = log.join(f, "id", "left").withColumn("bands", F.when(F.col("__b").isNotNull(), F.array_sort(F.array_union("bands", "__b"))).otherwise(F.col("bands")))
    status, message = completeness(F.col("bands"), required) if required else (F.lit(SUCCESS), F.lit("Tile found in storage."))
    here = F.col("__b").isNotNull()
    out = {"status": F.when(here, status).otherwise(F.col("status")), "message": F.when(here, message).otherwise(F.col("message"))}
    out["retries"] = F.when(here & (status == SUCCESS), 0).when(here, F.col("retries") + 1).otherwise(F.col("retries"))
    return df.withColumns(out).drop("__b")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """All records of JSON logs in order of time; unreadable lines and records without a name are left out."""
    df = spark.read.schema("id string, name string, status string, datetime string, message string").option("mode", "PERMISSIVE").json(path)
    return df.where("name is not null").withColumn("datetime", F.expr("try_to_timestamp(datetime)")).orderBy(F.col("datetime").asc_nulls_last(), "id")


def append_json(spark: SparkSession, path: str, name: str, status: str, message: str = "") -> None:
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    spark.range(1).select(F.substring(F.md5(F.concat(F.lit(name), now)), 1, 8).alias("id"), F.lit(name).alias("name"), F.lit(status).alias("status"), now.alias("datetime"), F.lit(message).alias("message")).write.mode("append").json(path)
