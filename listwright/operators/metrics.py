"""Alerts and peaks over host samples (sample_id, ts, memory_pct, cpu_pct, disk_pct)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.config import CPU_LIMIT, DISK_LIMIT, MEMORY_LIMIT
from listwright.functions.timing import one_decimal


# Shape of one logged host sample, as far as it is used here.
SAMPLE_SCHEMA = (
    "sample_id bigint, timestamp double, memory struct<percent:double>, cpu struct<percent:double>, disk struct<percent:double>"
)


def samples_from_log(log: DataFrame) -> DataFrame:
    """Host samples as they are logged (nested, epoch seconds) in flat columns."""
    return log.select(
        "sample_id",
        F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("bigint")).alias("ts"),
        *[F.col(f"{kind}.percent").alias(f"{kind}_pct") for kind in ("memory", "cpu", "disk")],
    )


def metric_alerts(
    samples: DataFrame, memory: float = MEMORY_LIMIT, cpu: float = CPU_LIMIT, disk: float = DISK_LIMIT
) -> DataFrame:
    """One row per limit that a sample exceeds. Works on batches and streams alike."""
    limits = {
        "memory": (memory, "High memory use: "),
        "cpu": (cpu, "High CPU use: "),
        "disk": (disk, "Low disk space: "),
    }
    checks = [
        F.when(
            F.col(f"{kind}_pct") > limit,
            F.struct(
                F.lit(kind).alias("type"),
                F.lit("warning").alias("level"),
                F.concat(F.lit(text), one_decimal(F.col(f"{kind}_pct")), F.lit("%")).alias("message"),
            ),
        )
        for kind, (limit, text) in limits.items()
    ]
    return samples.select(
        "sample_id", "ts", F.inline(F.array_compact(F.array(*checks)))
    )


def peak_metrics(samples: DataFrame, memory: float = MEMORY_LIMIT, cpu: float = CPU_LIMIT) -> DataFrame:
    """Peaks and how often a limit was passed: one row."""
    high_memory, high_cpu = F.col("memory_pct") > memory, F.col("cpu_pct") > cpu
    return samples.agg(
        F.max("memory_pct").alias("peak_memory_pct"),
        F.max("cpu_pct").alias("peak_cpu_pct"),
        F.count_if(high_memory).alias("memory_warnings"),
        F.count_if(high_cpu).alias("cpu_warnings"),
        F.count_if(high_memory | high_cpu).alias("throttle_events"),
    )
