"""Speed and remaining time of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.timing import eta_seconds, format_duration, percent, ratio, seconds_between

COUNTERS = ["processed_items", "successful_items", "failed_items", "skipped_items"]


def progress_counters() -> list[Column]:
    """Aggregates over an item log (job_name, ts, success, skipped)."""
    skipped = F.coalesce(F.col("skipped"), F.lit(False))
    return [
        F.count("*").alias("processed_items"),
        F.count_if(F.col("success") & ~skipped).alias("successful_items"),
        F.count_if(~F.col("success") & ~skipped).alias("failed_items"),
        F.count_if(skipped).alias("skipped_items"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("last_time"),
    ]


def with_speed(counters: DataFrame, total: Column) -> DataFrame:
    """Add the derived figures; every ratio is guarded against zero."""
    elapsed = seconds_between(F.col("start_time"), F.col("last_time"))
    return (
        counters.withColumn("total_items", total)
        .withColumn("elapsed_time", elapsed)
        .withColumn("items_per_second", ratio(F.col("processed_items"), F.col("elapsed_time")))
        .withColumn(
            "estimated_remaining",
            eta_seconds(F.col("total_items"), F.col("processed_items"), F.col("items_per_second")),
        )
        .withColumn("percent_complete", percent(F.col("processed_items"), F.col("total_items")))
        .withColumn("elapsed_text", format_duration(F.col("elapsed_time")))
        .withColumn("remaining_text", format_duration(F.col("estimated_remaining")))
    )


def throughput(items: DataFrame, total_items: int | None = None) -> DataFrame:
    """One row per job over an item log."""
    counters = items.groupBy("job_name").agg(*progress_counters())
    total = F.col("processed_items") if total_items is None else F.lit(total_items)
    return with_speed(counters, total)
