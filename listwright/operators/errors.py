"""Summaries over an error log (type, message, url, operation, ts, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.config import RECENT_ERRORS
from listwright.functions.errors import error_category, error_line, error_severity, is_retriable


LOG_SCHEMA = "id bigint, type string, message string, context map<string,string>, timestamp double"


def errors_from_log(log: DataFrame) -> DataFrame:
    """Error events as they are logged, with URL and operation taken from the context."""
    return log.select(
        "id", "type", "message",
        F.col("context")["url"].alias("url"),
        F.col("context")["operation"].alias("operation"),
        F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("bigint")).alias("ts"),
    )


def classify_errors(errors: DataFrame) -> DataFrame:
    operation = F.col("operation") if "operation" in errors.columns else F.lit(None).cast("string")
    return (
        errors.withColumn("category", error_category(F.col("type"), F.col("message")))
        .withColumn("severity", error_severity(F.col("category")))
        .withColumn("retriable", is_retriable(F.col("type"), F.col("message")))
        .withColumn(
            "line",
            error_line(F.col("category"), F.col("type"), F.col("message"), F.col("url"), operation),
        )
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("type").agg(F.count("*").alias("errors"))


def error_summary(errors: DataFrame, recent: int = RECENT_ERRORS) -> DataFrame:
    """One row: total, number of types, most common type, errors still held as recent.

    Equal counts are decided by name.
    """
    counts = error_counts(errors)
    total = F.coalesce(F.sum("errors"), F.lit(0))
    commonest = F.min(F.struct((-F.col("errors")).alias("n"), "type"))
    return counts.agg(
        total.alias("total_errors"),
        F.count("*").alias("error_types"),
        commonest["type"].alias("most_common_error"),
        F.least(total, F.lit(recent).cast("bigint")).alias("recent_errors_count"),
    )


def recent_errors(errors: DataFrame, limit: int = RECENT_ERRORS) -> DataFrame:
    return errors.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
