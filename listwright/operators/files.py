"""Which files are temporary, old or beyond the number to keep. Nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.config import LOG_KEEP_LATEST, LOG_MAX_AGE_DAYS
from listwright.functions.patterns import TEMP_PATTERNS, matches_patterns, not_preserved
from listwright.functions.timing import age_days


def older_than(files: DataFrame, at: Column, days: float) -> DataFrame:
    return files.where(age_days(F.col("mtime"), at) >= days)


def temp_files(
    files: DataFrame, at: Column, patterns: list[str] = TEMP_PATTERNS, max_age_days: float | None = None
) -> DataFrame:
    """Files named like temporary ones, of the given age, that need not be kept."""
    found = files.where(matches_patterns(F.col("path"), patterns) & not_preserved(F.col("path")))
    return found if max_age_days is None else older_than(found, at, max_age_days)


def newest(files: DataFrame, keep: int, group: list[str]) -> DataFrame:
    """The newest files per group.

    Without a group this is a plain top-k. With one, Spark cuts each map task to
    ``keep`` rows per group before the shuffle.
    """
    if not group:
        return files.orderBy(F.desc("mtime"), "path").limit(keep)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("mtime"), "path"))
    return files.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def retention_candidates(
    files: DataFrame,
    at: Column,
    max_age_days: float = LOG_MAX_AGE_DAYS,
    keep_latest: int = LOG_KEEP_LATEST,
    group: list[str] = (),
) -> DataFrame:
    """Old files beyond the newest ones, which are kept whatever their age."""
    kept = newest(files.select("path", "mtime", *group), keep_latest, list(group)).select("path")
    return older_than(files, at, max_age_days).join(kept, "path", "left_anti")
