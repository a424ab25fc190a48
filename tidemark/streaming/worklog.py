"""Streams over the same operators: time bins with a watermark, and work logs kept by merging micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import worklog


def binned(events: DataFrame, when: str, key: str, value: str, days: int = 5, late: str = "10 days") -> DataFrame:
    """Count and mean of each key in bins of so many days, counted from 1970-01-01; later events than the watermark are left out."""
    return (
        events.withWatermark(when, late)
        .groupBy(F.window(when, f"{days} days").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("time_bin"), key, "n", "mean")
    )


def keep_log(spark: SparkSession, events: DataFrame, path: str, checkpoint: str):
    """Merge each micro-batch of events into the log at path/v<batch>; a batch that runs again writes the same version again, so a lost executor or driver changes nothing."""

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{path}/v{number}") if number >= 0 else None
        worklog.merge(before, batch).write.mode("overwrite").parquet(f"{path}/v{number + 1}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
