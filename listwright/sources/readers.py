"""Readers for listing files, word lists, pages, logs and file inventories."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.config import NA_VALUES
from listwright.functions.text import file_extension, strip
from listwright.operators.schema import canonicalize_columns, ensure_column, normalize_headers, quoted
from listwright.sources.file_digests import digest_tasks, with_digest
from listwright.sources.listing_files import (
    HEADER_LIMIT,
    arrow_uri,
    column_names,
    first_record,
    listing_files,
    numbered_names,
    range_tasks,
    scan,
    split_errors,
)

CSV_GLOB = "*.[cC][sS][vV]"
_IRREGULAR = "_irregular"

PAGE_SCHEMA = "page_id bigint, url string, html string"


def _csv_options(multi_line: bool, header: bool = True, same_header: bool = False) -> dict[str, str]:
    return {
        "header": str(header).lower(),
        "encoding": "UTF-8",
        "mode": "PERMISSIVE",
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "columnNameOfCorruptRecord": _IRREGULAR,
        # With pruning a line is only cut into the columns asked for, and too
        # long lines would come back as soon as one column is left out.
        "columnPruning": "false",
        # Names are given by place, unless every file must have just these.
        "enforceSchema": str(not same_header).lower(),
    }


def _listing_schema(columns: list[str]) -> T.StructType:
    """Text columns plus the line itself where its number of fields is off."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _IRREGULAR]])


def _fits(columns: list[str]) -> Column:
    """Whether a line is no longer than the header; short lines are."""
    line = F.col(_IRREGULAR)
    # A doubled quote reads as the end of one quoted run and the start of the
    # next; without going back, no line is too long for the matcher.
    bare = F.regexp_replace(line, r'"[^"]*+"', "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(",")))
    # The reader refuses plans that touch nothing but the irregular line, so a
    # count needs a first column as well.
    read = F.length(F.coalesce(quoted(columns[0]), F.lit(""))) >= 0
    return line.isNull() | (read & (commas < len(columns)))


def _drop_long_lines(
    df: DataFrame, columns: list[str], na_values: list[str], on_bad_lines: str = "skip"
) -> DataFrame:
    if on_bad_lines not in ("skip", "error"):
        raise ValueError("on_bad_lines must be 'skip' or 'error'")
    good = _fits(columns)
    if on_bad_lines == "error":
        told = F.concat(F.lit(f"more than {len(columns)} fields: "), F.left(F.col(_IRREGULAR), F.lit(200)))
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))
    return df.where(good).select(
        *[
            F.when(~quoted(c).isin(na_values), quoted(c)).alias(c) if c in columns else quoted(c)
            for c in df.columns
            if c != _IRREGULAR
        ]
    )


def _raw_listings(
    spark: SparkSession, paths: str | list[str], columns: list[str], multi_line: bool, header: bool, glob: str,
    same_header: bool = False,
) -> DataFrame:
    return (
        spark.read.schema(_listing_schema(columns))
        .options(**_csv_options(multi_line, header, same_header))
        .option("maxColumns", str(max(20_480, 2 * len(columns))))
        .option("pathGlobFilter", glob)
        # Folder names stay part of the file name; they are no columns.
        .option("recursiveFileLookup", "true")
        .csv(paths)
    )


def rejected_lines(
    spark: SparkSession, paths: str | list[str], columns: list[str], multi_line: bool = False, header: bool = True,
    glob: str = CSV_GLOB,
) -> DataFrame:
    """``source_file, line``: what :func:`read_listings` skips."""
    raw = _raw_listings(spark, paths, columns, multi_line, header, glob)
    return raw.where(~_fits(columns)).select(
        F.col("_metadata.file_path").alias("source_file"), F.col(_IRREGULAR).alias("line"),
    )


def read_listings(
    spark: SparkSession,
    paths: str | list[str],
    columns: list[str],
    na_values: list[str] = NA_VALUES,
    multi_line: bool = False,
    ordinal: bool = False,
    header: bool = True,
    glob: str = CSV_GLOB,
    on_bad_lines: str = "skip",
    same_header: bool = False,
) -> DataFrame:
    """CSV files that share a header, every field as text; ``columns`` names the fields by place.

    Lines with too many fields are skipped (``on_bad_lines="error"``: they end
    the job), short lines are filled with NULL. With ``same_header`` a file whose
    header is not ``columns`` ends the job. ``ordinal`` adds ``source_file`` and a sortable position within it.
    """
    raw = _raw_listings(spark, paths, columns, multi_line, header, glob, same_header)
    if ordinal:
        raw = raw.select("*", *_position())
    return _drop_long_lines(raw, columns, na_values, on_bad_lines)


def _position() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("ordinal"),
    ]


def file_inventory(
    spark: SparkSession, path: str, extensions: list[str] | None = None, hashed: bool = False, glob: str = "*"
) -> DataFrame:
    """Files below a folder with size and time. Contents are read only for ``hashed``, a piece at a time."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    if extensions:
        files = files.where(file_extension(F.col("path")).isin([e.lower() for e in extensions]))
    columns = ["path", "length", F.col("modificationTime").alias("mtime")]
    if not hashed:
        return files.select(*columns)
    # Empty files are never copies of each other; the filter reaches the scan.
    found = files.where(F.col("length") > 0).select(*columns)
    return with_digest(found, tasks=digest_tasks(found))


def file_headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """First record of every file of an inventory, read on the executors."""

    def first_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            heads = []
            for path in batch["path"]:
                filesystem, local = fs.FileSystem.from_uri(arrow_uri(path))
                with filesystem.open_input_stream(local) as stream:
                    heads.append(first_record(stream.read)[0].decode("utf-8-sig", errors="replace"))
            yield pd.DataFrame({"path": batch["path"], "header": heads})

    return files.select("path").mapInPandas(first_records, "path string, header string")


def header_names(header: str) -> list[str]:
    """Column names of a header record, by the rules of CSV."""
    csv.field_size_limit(HEADER_LIMIT)
    return next(csv.reader(header.splitlines(keepends=True)), [])


def validate_source(files: DataFrame, required: str = "website") -> DataFrame:
    """Files of a header table that can be processed: not empty, with the column."""
    # Quoted names may hold commas, so a comma cuts only where the quotes before it are closed.
    cut = r',(?=(?:[^"]*"[^"]*")*+[^"]*$)'
    named = F.transform(
        F.split("header", cut),
        lambda h: F.lower(strip(F.replace(F.regexp_replace(strip(h), '^"|"$', ""), F.lit('""'), F.lit('"')))),
    )
    return files.where((F.col("header") != "") & F.array_contains(named, required))


# Columns from which on a plan with an expression for each costs more than reading in Python.
WIDE_HEADER = 500


def _uniform_header(spark: SparkSession, folder: str) -> str | None:
    """The header that all files of a folder share, if they do and it is one line of not too many columns."""
    inventory = file_inventory(spark, folder, glob=CSV_GLOB).where(F.col("length") > 0)
    found = file_headers(spark, inventory).select("header").distinct().limit(2).collect()
    if len(found) != 1:
        return None
    header = found[0]["header"]
    plain = "\n" not in header and "\r" not in header and len(header_names(header)) <= WIDE_HEADER
    return header if plain else None


def _of_one_header(
    spark: SparkSession, header: str, folder: str, na_values: list[str], multi_line: bool, on_bad_lines: str
) -> tuple[DataFrame, list[str]]:
    """Rows of files with one header, columns ``_h0`` and on, and the names they have there."""
    raw_names = header_names(header)
    names = [f"_h{i}" for i in range(len(raw_names))]
    raw = (
        spark.read.schema(_listing_schema(names))
        .options(**_csv_options(multi_line))
        .option("maxColumns", str(max(20_480, 2 * len(names))))
        .option("pathGlobFilter", CSV_GLOB)
        .option("recursiveFileLookup", "true")
        .csv(folder)
    )
    return _drop_long_lines(raw.select("*", *_position()), names, na_values, on_bad_lines), raw_names


def _of_any_header(
    spark: SparkSession, folder: str, naming: str, na_values: list[str], multi_line: bool, on_bad_lines: str,
    skip: DataFrame | list[str] | None = None,
) -> DataFrame:
    """Rows of all files, each under its own header, in one scan."""
    files = listing_files(spark, folder, CSV_GLOB, skip).where("length > 0")
    tasks = range_tasks(files)
    columns = column_names(files, naming, tasks)
    return scan(files, columns, naming, na_values, multi_line, on_bad_lines, tasks=tasks).drop("error")


def read_listing_folder(
    spark: SparkSession,
    folder: str,
    na_values: list[str] = NA_VALUES,
    multi_line: bool = False,
    skip: DataFrame | list[str] | None = None,
    on_bad_lines: str = "skip",
) -> DataFrame:
    """All CSV files of a folder with canonical columns, ``source_file`` and ``ordinal``.

    Where all files share a header Spark's own reader takes the folder; else each
    file is read under its own header, all in one scan. ``skip`` names files that
    were processed before, best as a table (``source_file``).
    """
    header = None if skip is not None else _uniform_header(spark, folder)
    if header is None:
        rows = _of_any_header(spark, folder, "canonical", na_values, multi_line, on_bad_lines, skip)
        return ensure_column(rows, "website")
    batch, raw_names = _of_one_header(spark, header, folder, na_values, multi_line, on_bad_lines)
    names = [c for c in batch.columns if c not in ("source_file", "ordinal")]
    fields = normalize_headers(batch.select(*names).toDF(*raw_names))
    return canonicalize_columns(batch.toDF(*fields.columns, "source_file", "ordinal"))


def read_listing_folder_isolated(
    spark: SparkSession, folder: str, na_values: list[str] = NA_VALUES, skip: DataFrame | list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that can be read, and ``source_file, stage, error`` of the others.

    A file without a header, without any known column, with bytes that are no
    text or with a quote that is never closed is left out as a whole.
    """
    files = listing_files(spark, folder, CSV_GLOB, skip)
    tasks = range_tasks(files)
    columns = column_names(files, "canonical", tasks, isolate=True)
    rows, errors = split_errors(scan(files, columns, "canonical", na_values, isolate=True, tasks=tasks))
    return ensure_column(ensure_column(rows, "website"), "email"), errors


def read_as_written(spark: SparkSession, path: str, on_bad_lines: str = "error") -> DataFrame:
    """CSV files under their own column names; files with other headers are joined by name.

    A name that a header has more than once gets a number, so no column is lost.
    """
    header = _uniform_header(spark, path)
    if header is not None:
        batch, raw_names = _of_one_header(spark, header, path, NA_VALUES, False, on_bad_lines)
        return batch.drop("source_file", "ordinal").toDF(*numbered_names(raw_names))
    rows = _of_any_header(spark, path, "written", NA_VALUES, False, on_bad_lines).drop("source_file", "ordinal")
    if not rows.columns:
        raise ValueError(f"no listing file in {path}")
    return rows


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Trimmed lines that are not blank."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")


def load_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct lower-cased words of all text files of a folder."""
    return read_lines(spark, folder, "*.txt").select(F.lower("line").alias("token")).distinct()


def config_lines(text: str) -> list[str]:
    """Entries of a list file that is job configuration."""
    return [line.strip() for line in text.splitlines() if line.strip()]


def parse_rename_map(text: str) -> dict[str, str]:
    """``old:new`` per line, cut at the first colon; other lines are ignored."""
    pairs = (line.split(":", 1) for line in config_lines(text) if ":" in line)
    return {old.strip(): new.strip() for old, new in pairs}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_progress_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of progress or host samples."""
    return spark.read.schema(schema).json(path)
