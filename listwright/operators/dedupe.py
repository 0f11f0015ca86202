"""First, latest and duplicate rows, without gathering a group in one place.

Survivors are chosen with ``min_by`` / ``max_by``: every map task keeps one row
per key before the shuffle, so a key that holds a third of the rows costs no
more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import content_md5
from listwright.session import materialize


def keep_first(df: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    """One row per key: the one that comes first in source order."""
    return _survivor(df, keys, F.min_by(F.struct(*_rest(df, keys)), ordinal))


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the last write."""
    return _survivor(df, keys, F.max_by(F.struct(*_rest(df, keys)), order))


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _survivor(df: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    picked = df.groupBy(*keys).agg(chosen.alias("_row"))
    return picked.select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    )


def with_fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """Non-empty files with their md5. Equal size is part of the key.

    Contents are read and hashed once: the fingerprints are stored.
    """
    hashed = files.where(F.col("length") > 0).withColumn("content_md5", content_md5(F.col(content))).drop(content)
    return materialize(hashed, "fingerprints")


GROUP = ["length", "content_md5"]


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Size and md5 shared by more than one file, with the number of copies."""
    return (
        files.groupBy(*GROUP)
        .agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))
        .where(F.col("copies") > 1)
        .withColumn("redundant_bytes", F.col("length") * (F.col("copies") - 1))
    )


def duplicate_members(files: DataFrame) -> DataFrame:
    """Every file that has a copy."""
    return files.join(duplicate_groups(files).select(*GROUP), GROUP, "left_semi").select(*files.columns)


def duplicates_to_drop(files: DataFrame, keep: str = "newest") -> DataFrame:
    """Every copy but one per group: the newest, or the first by path, is kept.

    Only groups of more than one file meet the files again.
    """
    if keep == "newest":
        # Equal times fall back to the smallest path.
        first = F.struct((-F.unix_micros(F.col("mtime").cast("timestamp"))).alias("age"), "path")
    elif keep == "first":
        first = F.struct("path")
    else:
        raise ValueError("keep must be 'newest' or 'first'")
    groups = files.groupBy(*GROUP).agg(F.count("*").alias("_copies"), F.min(first).alias("_first")).where("_copies > 1")
    kept = groups.select(*GROUP, F.col("_first.path").alias("_kept"))
    return files.join(kept, GROUP).where(F.col("path") != F.col("_kept")).select(*files.columns)
