"""Writers for listings, reports and logs."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.config import DATA_SHEET, STATS_SHEET


def write_listings(df: DataFrame, path: str, mode: str = "error", by: str | None = None) -> None:
    """CSV with a header. ``by`` writes one sub-folder per value of a column.

    Rows of one value are brought together first, and split again where a value
    holds too many of them.
    """
    if by:
        df = df.hint("rebalance", by)
    writer = df.write.mode(mode).options(
        header="true", escape='"', emptyValue="",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    )
    (writer.partitionBy(by) if by else writer).csv(path)


def write_once(df: DataFrame, path: str) -> None:
    """Do nothing when the output is already there."""
    df.write.mode("ignore").parquet(path)


def unprocessed(df: DataFrame, manifest: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows of files that no earlier run has recorded in the manifest."""
    return df.join(manifest.select(source).distinct(), source, "left_anti")


def _version(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/log").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def replace_in_place(df: DataFrame, path: str) -> None:
    """Make ``df`` the current version of a dataset; it may have been read from there.

    A version is a folder of its own, and one row in ``log`` makes it current
    once it is complete. A run that breaks off leaves the version before as it
    was, and its folder is written anew by the next. Nothing is renamed, so
    this holds on object stores as well; old versions stay until they are
    cleared away.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    version = _version(spark, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version}")
    row = spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
    row.write.mode("append").parquet(f"{path}/log")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a dataset that :func:`replace_in_place` writes."""
    return spark.read.parquet(f"{path.rstrip('/')}/v{_version(spark, path)}")


def sheet_order(names: list[str]) -> list[str]:
    """Data and statistics first, the others as given."""
    first = [n for n in (DATA_SHEET, STATS_SHEET) if n in names]
    return first + [n for n in names if n not in first]


def write_report(report: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """One parquet folder per sheet. Sheets other than the data are small."""
    for name in sheet_order(list(report)):
        report[name].write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def read_report(spark: SparkSession, path: str, sheets: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in sheet_order(sheets)}


def copy_other_sheets(
    result: dict[str, DataFrame], original: dict[str, DataFrame], only_missing: bool = True
) -> dict[str, DataFrame]:
    """Result sheets plus those of the original the result does not have."""
    others = {
        n: s for n, s in original.items()
        if n not in (DATA_SHEET, STATS_SHEET) and not (only_missing and n in result)
    }
    return {**result, **others}


def output_name(path: str, suffix: str = "_demo", formats: tuple[str, ...] = (".csv", ".parquet")) -> str:
    """``name.csv`` to ``name_demo.csv``; one suffix, kept before the extension."""
    stem, extension = os.path.splitext(path)
    if extension.lower() not in formats:
        raise ValueError(f"unsupported format: {extension or path}")
    return path if stem.endswith(suffix) else stem + suffix + extension


def text_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per line of a text column, numbered from 0."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def notice_table(spark: SparkSession, text: str) -> DataFrame:
    """The lines of a notice as a sheet."""
    return text_lines(spark.range(1).select(F.lit(text).alias("text")), "text")


def append_progress(
    samples: DataFrame,
    path: str,
    checkpoint: DataFrame | None = None,
    cache: DataFrame | None = None,
    key: str = "job_name",
) -> None:
    """Append samples as JSON lines, with job progress and cache figures nested in them.

    ``checkpoint`` has one row per job and ``cache`` one row per job; both are
    aggregates.
    """
    out = samples
    for name, extra in (("checkpoint", checkpoint), ("cache", cache)):
        if extra is not None:
            nested = extra.select(key, F.struct(*[c for c in extra.columns if c != key]).alias(name))
            out = out.join(nested, key, "left")
    out.write.mode("append").json(path)
