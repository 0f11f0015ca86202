"""Whole jobs, composed from the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.config import (
    CONTACT_COLUMNS,
    DATA_SHEET,
    ERRORS_SHEET,
    NA_VALUES,
    NOTICE_SHEET,
    SECTORS_SHEET,
    STATS_SHEET,
)
from listwright.functions.text import normalize_url, strip
from listwright.operators.attempts import pending_rows
from listwright.operators.contacts import attach_contacts, extract_contacts, has_website, verified_contacts
from listwright.operators.dedupe import keep_first, latest_per_key
from listwright.operators.exclusion import exclude_emails, exclude_emails_by_table
from listwright.operators.masking import mask_report, mask_sweep, mask_table, sweep_addresses
from listwright.operators.schema import clean_frame, ensure_column, pick_sector_columns, quoted
from listwright.operators.stats import (
    contact_stats,
    contact_stats_by,
    extraction_stats,
    sector_counts,
    sort_by_reviews,
    stats_long,
    top_sectors,
)
from listwright.session import materialize
from listwright.sources.readers import read_as_written, read_listing_folder, read_listing_folder_isolated
from listwright.sources.writers import (
    copy_other_sheets,
    notice_table,
    output_name,
    read_report,
    write_listings,
    write_report,
)

Report = dict[str, DataFrame]


def clean_listings(df: DataFrame, **columns) -> DataFrame:
    """Normalise and deduplicate listings that carry ``source_file`` and ``ordinal``.

    One shuffle: the first row of each website within its file.
    """
    df = ensure_column(df, "website")
    df = has_website(df.withColumn("website", normalize_url(F.col("website"))))
    df = keep_first(df, ["source_file", "website"], F.col("ordinal"))
    cleaned, _ = clean_frame(df, **columns)
    return cleaned


def clean_job(
    spark: SparkSession, folder: str, na_values: list[str] = NA_VALUES, skip: DataFrame | list[str] | None = None,
    **columns,
) -> DataFrame:
    """Folder of CSV files to one clean listing table; ``skip`` are files of earlier runs."""
    return clean_listings(read_listing_folder(spark, folder, na_values, skip=skip), **columns)


def extract_data(
    listings: DataFrame,
    pages: DataFrame,
    row_key: str,
    domains: DataFrame | None = None,
    mode: str = "advanced",
    attempts: DataFrame | None = None,
    page_order: Column | None = None,
    stored: DataFrame | None = None,
    **columns,
) -> DataFrame:
    """Listings with the contacts of their pages.

    Pages of sites that nobody asks for are left out before the scan, and the
    texts are scanned once: what was found is stored before it is joined.
    With ``attempts`` only rows without a success are worked on; the others are
    in the result as well, with what ``stored`` has for them (columns
    ``row_key`` and contacts) from the runs before. With ``domains`` only
    addresses that pass verification are kept. ``page_order`` chooses the last
    among several fetches of one URL.
    """
    everything = listings
    if attempts is not None:
        listings = pending_rows(listings, attempts)
    order = F.lit(0) if page_order is None else page_order
    sites = listings.select(strip(F.col("website")).alias("_site")).where("_site IS NOT NULL").distinct()
    wanted = pages.withColumn("_order", order).join(sites, F.col("url") == F.col("_site"), "left_semi")
    contacts = extract_contacts(wanted, carry=["_order"])
    # One fetch per URL counts; equal ones are told apart by what was found.
    latest = F.struct("_order", *CONTACT_COLUMNS)
    contacts = latest_per_key(contacts, ["website"], latest).drop("_order")
    contacts = materialize(contacts, "contacts")
    if domains is not None:
        contacts = verified_contacts(contacts, domains, mode)
    fresh = attach_contacts(listings, contacts, row_key)
    if attempts is not None:
        fresh = _with_completed(everything, fresh, stored, row_key)
    return clean_frame(fresh, **columns)[0]


def _with_completed(listings: DataFrame, fresh: DataFrame, stored: DataFrame | None, row_key: str) -> DataFrame:
    """Fresh rows and those completed before; contacts of the latter are the stored ones."""
    done = listings.join(fresh.select(row_key), row_key, "left_anti")
    if stored is not None:
        kept = [c for c in CONTACT_COLUMNS if c in stored.columns]
        found = latest_per_key(stored.select(row_key, *kept), [row_key], F.struct(*kept))
        done = done.drop(*kept).join(found, row_key, "left")
    return fresh.unionByName(done, allowMissingColumns=True)


def extraction_report(data: DataFrame, notice: str | None = None) -> Report:
    report = {DATA_SHEET: data, STATS_SHEET: extraction_stats(data)}
    if "main_category" in data.columns:
        report[SECTORS_SHEET] = sector_counts(data)
    if notice:
        report[NOTICE_SHEET] = notice_table(data.sparkSession, notice)
    return report


def extract_job(
    listings: DataFrame, pages: DataFrame, row_key: str, notice: str | None = None, **options
) -> Report:
    """Extraction as a report; see :func:`extract_data` for the options."""
    return extraction_report(extract_data(listings, pages, row_key, **options), notice)


def exclude_data(data: DataFrame, tokens: Iterable[str] | DataFrame, row_key: str | None = None) -> DataFrame:
    """Data without unwanted addresses; a table of words needs a ``row_key``."""
    if isinstance(tokens, DataFrame):
        if row_key is None:
            raise ValueError("a table of words needs a row_key")
        excluded = exclude_emails_by_table(data, tokens, row_key)
    else:
        excluded = exclude_emails(data, tokens)
    return excluded.select(*[quoted(c) for c in data.columns])


def exclusion_report(data: DataFrame, original: Report) -> Report:
    """New data and statistics, the other sheets as they were."""
    return copy_other_sheets({DATA_SHEET: data, STATS_SHEET: contact_stats(data)}, original)


def exclusion_job(report: Report, tokens: Iterable[str] | DataFrame, row_key: str | None = None) -> Report:
    if DATA_SHEET not in report:
        raise ValueError(f"report has no sheet '{DATA_SHEET}'")
    return exclusion_report(exclude_data(report[DATA_SHEET], tokens, row_key), report)


def report_views(report: Report, ordinal: list[str], sectors: int = 20) -> Report:
    """The tables behind the pictures of a report."""
    data = report[DATA_SHEET]
    ordered = sort_by_reviews(data, ordinal) if "reviews" in data.columns else data.orderBy(*ordinal)
    views = {
        "top_data": ordered,
        "statistics_long": stats_long(report[STATS_SHEET]),
    }
    if SECTORS_SHEET in report:
        picked = pick_sector_columns(report[SECTORS_SHEET], ("sector", "number_of_companies"))
        if picked is not None:
            views["top_sectors"] = top_sectors(picked, sectors)
    return views


def mask_job(report: Report, **options) -> Report:
    return mask_report(report, **options)


def mask_file(spark: SparkSession, path: str, out: str | None = None, **options) -> str:
    """Masked copy of a CSV or parquet dataset beside it, under a ``_demo`` name.

    CSV is masked by column, and whatever looks like an address in any other
    column as well; parquet (the data sheet of a report) is swept.
    Files with other headers are masked under their own names. A line that does
    not fit its header ends the job, so no row is lost and none stays readable;
    nothing is written when masking fails.
    """
    out = out or output_name(path)
    if path.lower().endswith(".csv"):
        masked = mask_table(sweep_addresses(read_as_written(spark, path), **options), **options)
        write_listings(masked, out)
    else:
        mask_sweep(spark.read.parquet(path), **options).write.parquet(out)
    return out


def full_flow(
    spark: SparkSession,
    folder: str,
    pages: DataFrame,
    tokens: Iterable[str] | DataFrame,
    out: str,
    domains: DataFrame | None = None,
    **columns,
) -> Report:
    """Clean, extract, exclude and mask. Every stage is written before the next starts.

    The written tables cut the lineage, so a lost executor costs one stage at
    most; an error in a stage ends the flow. A flow that is started again with
    the same ``out`` goes on after the last stage that was written to its end.
    """
    row_key = "listing_id"
    cleaned = clean_job(spark, folder, **columns)
    identity = F.sha2(F.concat_ws("\n", "source_file", "website"), 256)
    listings = _stored(cleaned.withColumn(row_key, identity), f"{out}/clean")

    data = _stored(extract_data(listings, pages, row_key, domains, **columns), f"{out}/extracted/{DATA_SHEET}")
    extracted = _with_sheets(extraction_report(data), f"{out}/extracted")
    data = _stored(exclude_data(data, tokens, row_key), f"{out}/excluded/{DATA_SHEET}")
    excluded = _with_sheets(exclusion_report(data, extracted), f"{out}/excluded")
    demo = mask_job(excluded, keep=[row_key, "source_file"])
    _stored(demo[DATA_SHEET], f"{out}/demo/{DATA_SHEET}")
    return _with_sheets(demo, f"{out}/demo")


def _stored(df: DataFrame, path: str) -> DataFrame:
    """A stage as a table. One that was written to its end is only read; what is left of another is written anew."""
    spark = df.sparkSession
    mark = f"{path.rstrip('/')}.done"
    try:
        spark.read.parquet(mark).count()
    except AnalysisException:
        df.write.mode("overwrite").parquet(path)
        spark.range(1).write.mode("overwrite").parquet(mark)
    return spark.read.parquet(path)


def _with_sheets(report: Report, path: str) -> Report:
    """Write the sheets that are computed from stored data; the report as it lies there."""
    write_report({name: sheet for name, sheet in report.items() if name != DATA_SHEET}, path, mode="overwrite")
    first = next(iter(report.values()))
    return read_report(first.sparkSession, path, list(report))


def auto_flow(
    data: DataFrame, tokens: Iterable[str] | DataFrame, source: str = "source_file", row_key: str | None = None,
    keep: Iterable[str] = (), **options: bool
) -> Report:
    """Exclude and mask every file of a folder at once; statistics come per file.

    A table of words needs a ``row_key``.
    """
    excluded = exclude_data(data, tokens, row_key)
    return {
        DATA_SHEET: mask_sweep(excluded, keep=[source, *keep], **options),
        STATS_SHEET: contact_stats_by(excluded, source),
    }


def auto_flow_folder(
    spark: SparkSession, folder: str, tokens: Iterable[str] | DataFrame, na_values: list[str] = NA_VALUES,
    skip: DataFrame | list[str] | None = None, **options: bool,
) -> Report:
    """:func:`auto_flow` of all listing files of a folder; one that fails is left out and the others go on.

    Sheet ``errors`` has ``source_file, stage, error`` of the files left out:
    ``open`` (not readable at all), ``header`` (none, or no known column), ``read``
    (bytes that are no text, a quote that is never closed).
    """
    rows, errors = read_listing_folder_isolated(spark, folder, na_values, skip)
    place = F.concat_ws("\n", "source_file", F.col("ordinal.block").cast("string"), F.col("ordinal.line").cast("string"))
    keyed = rows.withColumn("listing_id", F.sha2(place, 256)).drop("ordinal")
    report = auto_flow(keyed, tokens, row_key="listing_id", keep=["listing_id"], **options)
    return {**report, ERRORS_SHEET: errors}
