"""Queries that go through files: sources, sinks, streams and whole jobs.

Inputs are first written by Spark from the driver's tables, to a fresh folder
below the shared one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.config import NA_VALUES
from listwright.functions.masks import mask_email
from listwright.operators import errors, metrics, progress, stats
from listwright.operators.attempts import job_progress
from listwright.plans import contacts as contact_queries
from listwright.plans import flows, jobs
from listwright.plans import pages as page_queries
from listwright.plans import sqltext as q
from listwright.plans.fixtures import Tables
from listwright.plans.registry import query
from listwright.session import shared_dir
from listwright.sources import readers, writers
from listwright.streaming import streams

# -- sources ----------------------------------------------------------------

HEADERS = ["Nombre", "Sitio Web", "Correo", "Teléfono", "Dirección", "Categoría", "reviews"]
FIELDS = ["name", "website", "email", "phone", "address", "main_category", "reviews"]


@query(
    """SELECT c_name AS name, CASE WHEN c_custkey % 5 <> 1 THEN c_mktsegment END AS segment,
 CASE WHEN c_custkey % 5 <> 1 AND c_custkey % 7 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS code FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 5 <> 2"""
)
def read_listings(t: Tables) -> DataFrame:
    """Every fifth line is too long, every fifth ends with a stray comma, every fifth is short."""
    folder = shared_dir(t.spark, "irregular")
    t.table("customer").selectExpr(
        """CASE c_custkey % 5 WHEN 0 THEN concat(c_name, ',"a,b",', c_custkey, ',extra,more')
             WHEN 2 THEN concat(c_name, ',', c_mktsegment, ',', c_custkey, ',')
             WHEN 1 THEN c_name
             ELSE concat('"', c_name, '",', c_mktsegment, ',', if(c_custkey % 7 = 0, 'N/A', string(c_custkey))) END AS line"""
    ).write.option("compression", "none").text(folder)
    return readers.read_listings(t.spark, folder, ["name", "segment", "code"], header=False, glob="*.txt")


@query(
    """SELECT c_name || ',"a,b",' || CAST(c_custkey AS VARCHAR) || ',extra,more' AS line FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_name || ',' || c_mktsegment || ',' || CAST(c_custkey AS VARCHAR) || ',' FROM customer WHERE c_custkey % 5 = 2"""
)
def rejected_lines(t: Tables) -> DataFrame:
    """What the skipping reader leaves out."""
    folder = shared_dir(t.spark, "rejected")
    t.table("customer").selectExpr(
        """CASE c_custkey % 5 WHEN 0 THEN concat(c_name, ',"a,b",', c_custkey, ',extra,more')
             WHEN 2 THEN concat(c_name, ',', c_mktsegment, ',', c_custkey, ',')
             WHEN 1 THEN c_name ELSE concat(c_name, ',x,y') END AS line"""
    ).write.option("compression", "none").text(folder)
    found = readers.rejected_lines(t.spark, folder, ["name", "segment", "code"], header=False, glob="*.txt")
    return found.select("line")


WIDE = 6000


@query("SELECT c_custkey AS id, 'https://shop' || CAST(c_custkey AS VARCHAR) || '.net' AS website, c_name AS last_column, 6002 AS columns FROM customer")
def wide_header(t: Tables) -> DataFrame:
    """A header of more than 64 KiB that holds a quoted line break and a quoted comma."""
    folder = shared_dir(t.spark, "wide")
    blank = F.lit(None).cast("string")
    names = [f"a_very_wide_column_{k}" for k in range(WIDE)]
    rows = t.table("customer").repartition(3, "c_custkey").select(
        F.concat(F.lit("shop"), F.col("c_custkey").cast("string"), F.lit(".net")).alias("website"),
        *[blank.alias(n) for n in names], F.col("c_name").alias("the last,\ncolumn"),
    )
    writers.write_listings(rows, folder)
    read = readers.read_listing_folder(t.spark, folder)
    wide = len([c for c in read.columns if c not in ("source_file", "ordinal")])
    last = next(c for c in read.columns if c.startswith("the last"))
    return read.select(
        F.regexp_extract("website", "shop([0-9]+)", 1).cast("bigint").alias("id"),
        F.concat(F.lit("https://"), F.col("website")).alias("website"), F.col(f"`{last}`").alias("last_column"), F.lit(wide).alias("columns"),
    )


def raw_folder(t: Tables) -> str:
    """Contacts as CSV files with Spanish headers, one sub-folder per country, in row order."""
    folder = shared_dir(t.spark, "listings")
    raw = t.contacts.select("row_id", "country", *[F.col(c).alias(h) for c, h in zip(FIELDS, HEADERS)])
    ordered = raw.hint("rebalance", "country").sortWithinPartitions("country", "row_id").drop("row_id")
    ordered.write.partitionBy("country").options(
        header="true", escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(folder)
    return folder


def raw_lines(lines: DataFrame, folder: str) -> None:
    """A column of text as CSV files, line by line as it is."""
    lines.coalesce(1).write.options(
        header="false", sep="\u0001", quote="\u0002", escapeQuotes="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(folder)


def mixed_files(t: Tables, folder: str, contacts: DataFrame, broken: bool = True) -> str:
    """Contacts as CSV files under two headers, a sub-folder per country; beside them a truncated, a binary and a header-less file."""
    options = dict(header="true", escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    spanish = contacts.where("row_id % 3 = 0").select("country", "row_id", *[F.col(c).alias(h) for c, h in zip(FIELDS, HEADERS)])
    english = contacts.where("row_id % 3 <> 0").select(
        "country", F.col("phone").alias("Phone"), F.col("website").alias("Web"), "reviews", F.col("email").alias("Mail"), "row_id", "name", F.col("address").alias("Dir."),
    )
    for name, rows in (("es", spanish), ("en", english)):
        rows.hint("rebalance", "country").write.partitionBy("country").options(**options).csv(f"{folder}/{name}")
    if broken:
        names = t.table("supplier").select(F.concat_ws(",", "s_name", "s_suppkey").alias("line"))
        head = t.spark.createDataFrame([("name,website",)], "line string")
        raw_lines(names, f"{folder}/headless")
        raw_lines(head.unionAll(names).unionAll(t.spark.createDataFrame([('cut,"in the mid',)], "line string")), f"{folder}/truncated")
        raw_lines(head.unionAll(names).unionAll(t.spark.createDataFrame([("a\0b,\0\0",)], "line string")), f"{folder}/binary")
    return folder


def country_of(path: str) -> Column:
    return F.regexp_extract(path, "country=([^/]+)/", 1).alias("country")


BLANK = "nullif(email, '')"
READ = f"""listings AS (SELECT row_id, name, website, {BLANK} AS email, phone, address, main_category AS sector, nullif(reviews, 'n/a') AS reviews, country FROM contacts)"""


@query(f"WITH {READ} SELECT * EXCLUDE (row_id) FROM listings", "contacts")
def read_listing_folder(t: Tables) -> DataFrame:
    rows = readers.read_listing_folder(t.spark, raw_folder(t))
    return rows.withColumn("country", country_of("source_file")).drop("source_file", "ordinal")


@query("SELECT country, count(*) AS rows FROM contacts GROUP BY 1", "contacts")
def rows_per_source_file(t: Tables) -> DataFrame:
    rows = stats.rows_per_file(readers.read_listing_folder(t.spark, raw_folder(t)))
    return rows.groupBy(country_of("source_file")).agg(F.sum("rows").alias("rows"))


@query("SELECT DISTINCT country FROM contacts", "contacts")
def validate_source(t: Tables) -> DataFrame:
    inventory = readers.file_inventory(t.spark, raw_folder(t), glob=readers.CSV_GLOB)
    valid = readers.validate_source(readers.file_headers(t.spark, inventory), "sitio web")
    return valid.select(country_of("path")).distinct()


@query("SELECT c_custkey AS id, trim(c_name) AS line FROM customer WHERE c_custkey % 4 <> 0")
def read_lines(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "lines")
    t.table("customer").selectExpr(
        "if(c_custkey % 4 = 0, '  \t ', concat(' \t', c_name, '  ')) AS value"
    ).write.text(folder)
    lines = readers.read_lines(t.spark, folder)
    return lines.select(F.regexp_extract("line", "#0*([0-9]+)$", 1).cast("bigint").alias("id"), "line")


@query("SELECT DISTINCT lower(trim(p_name)) AS token FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer")
def load_tokens(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "tokens")
    t.table("part").selectExpr("concat(' ', upper(p_name)) AS value").write.text(folder)
    t.table("customer").selectExpr("c_mktsegment AS value").write.mode("append").text(folder)
    return readers.load_tokens(t.spark, folder)


@query("SELECT event_id AS sample_id, event_id % 101 AS memory_pct FROM events")
def progress_log(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "samples")
    writers.append_progress(t.view("metrics"), folder)
    return readers.read_progress_log(t.spark, folder, "sample_id bigint, memory_pct bigint")


# -- sinks ------------------------------------------------------------------


@query(f"SELECT name, website, {BLANK} AS email, country FROM contacts", "contacts")
def write_listings(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "written")
    columns = ["name", "website", "email"]
    writers.write_listings(t.contacts.select(*columns, "country"), folder, by="country")
    rows = readers.read_listings(t.spark, folder, columns, ordinal=True)
    return rows.select(*columns, country_of("source_file"))


REPORT_SQL = f"""WITH {q.EXCLUDED}
SELECT 'data' AS sheet, count(*) AS rows FROM excluded UNION ALL SELECT 'statistics', 1
UNION ALL SELECT 'sectors', count(DISTINCT main_category) FROM contacts"""


def contact_report(t: Tables) -> dict[str, DataFrame]:
    return {
        "sectors": stats.sector_counts(t.contacts),
        "data": t.contacts,
        "statistics": stats.extraction_stats(t.contacts),
    }


@query(REPORT_SQL, "contacts")
def write_report(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "report")
    report = contact_report(t)
    writers.write_report(report, folder)
    sheets = writers.read_report(t.spark, folder, list(report))
    counted = [s.agg(F.count("*").alias("rows")).select(F.lit(n).alias("sheet"), "rows") for n, s in sheets.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("SELECT main_category AS sector, count(*) AS number_of_companies FROM contacts WHERE main_category IS NOT NULL GROUP BY 1", "contacts")
def copy_other_sheets(t: Tables) -> DataFrame:
    result = {"data": t.contacts.select("row_id")}
    return writers.copy_other_sheets(result, contact_report(t))["sectors"]


@query("SELECT c_custkey AS id FROM customer")
def write_once(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "once")
    rows = t.table("customer").select(F.col("c_custkey").alias("id"))
    writers.write_once(rows, folder)
    writers.write_once(rows.withColumn("id", -F.col("id")), folder)
    return t.spark.read.parquet(folder)


@query("SELECT row_id, country AS source_file FROM contacts WHERE country NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 0)", "contacts")
def unprocessed(t: Tables) -> DataFrame:
    rows = t.contacts.select("row_id", F.col("country").alias("source_file"))
    done = t.table("nation").where("n_regionkey = 0").select(F.col("n_name").alias("source_file"))
    return writers.unprocessed(rows, done)


@query(f"SELECT row_id, {q.mask_email('email')} AS email FROM contacts", "contacts")
def replace_in_place(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "in-place")
    writers.replace_in_place(t.contacts.select("row_id", "email"), folder)
    now = writers.read_current(t.spark, folder)
    writers.replace_in_place(now.withColumn("email", mask_email(F.col("email"))), folder)
    return writers.read_current(t.spark, folder)


@query(
    f"""WITH {jobs.STATE}, {jobs.THROUGHPUT}
SELECT c.job_name, processed_items, count(*) FILTER (WHERE completed) AS completed, count(*) AS total
FROM counters c JOIN state s ON s.job_name = c.job_name GROUP BY 1, 2""",
    "attempts",
)
def append_progress(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "progress")
    writers.append_progress(progress.throughput(t.attempts), folder, checkpoint=job_progress(t.attempts))
    schema = "job_name string, processed_items bigint, checkpoint struct<completed:bigint,total:bigint>"
    return readers.read_progress_log(t.spark, folder, schema).select("job_name", "processed_items", "checkpoint.*")


# -- streams ----------------------------------------------------------------


SLICE_ROWS, FILE_ROWS = 20_000_000, 1_000_000


def staged(t: Tables, df: DataFrame, name: str) -> tuple[str, str, str]:
    """Input folder filled with a table, output folder and checkpoint of a stream."""
    base = shared_dir(t.spark, name)
    df.write.parquet(f"{base}/in")
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def stream_of(t: Tables, df: DataFrame, name: str, files: int | None = None) -> tuple[DataFrame, str, str]:
    """A stream of the table; ``files`` cuts it into twice as many files, two for each micro-batch."""
    folder, out, checkpoint = staged(t, df.repartition(2 * files) if files else df, name)
    return streams.parquet_stream(t.spark, folder, ddl(df), 2 if files else None), out, checkpoint


@query(f"WITH {READ} SELECT name, website, email, phone, reviews, country FROM listings", "contacts")
def listing_stream(t: Tables) -> DataFrame:
    """Files of two headers, the second half after a restart, among files that are broken."""
    folder, base = shared_dir(t.spark, "mixed-stream"), shared_dir(t.spark, "listing-stream")
    columns = ["name", "website", "email", "phone", "reviews"]
    for half, broken in ((0, True), (1, False)):
        mixed_files(t, f"{folder}/half{half}", t.contacts.where(F.col("row_id") % 2 == half), broken)
        rows = streams.listing_stream(t.spark, folder, columns, NA_VALUES, files_per_batch=200)
        streams.write_stream(rows, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out, _ = streams.read_listing_stream(t.spark, f"{base}/out")
    return out.select(*columns, country_of("source_file"))


@query(f"WITH {q.PAGE_CONTACTS} SELECT website, {page_queries.CELLS} FROM page_contacts", "linked_pages")
def extract_stream(t: Tables) -> DataFrame:
    folder, out, checkpoint = staged(t, t.view("linked_pages"), "extract-stream")
    streams.extract_stream(streams.page_stream(t.spark, folder), out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out)


@query(f"WITH {jobs.STATE} SELECT job_name, row_id, completed, failed FROM state", "attempts")
def attempt_state_stream(t: Tables) -> DataFrame:
    log, out, checkpoint = stream_of(t, t.attempts, "attempt-stream", 3)
    streams.attempt_state_stream(log, out, checkpoint).awaitTermination()
    return streams.read_attempt_state(t.spark, out).select("job_name", "row_id", "completed", "failed")


@query(
    f"""WITH {jobs.THROUGHPUT} SELECT job_name, processed_items, successful_items, failed_items, skipped_items,
 round(items_per_second, 9) AS items_per_second FROM speed""",
    "attempts",
)
def progress_stream(t: Tables) -> DataFrame:
    log, out, checkpoint = stream_of(t, t.attempts, "progress-stream", 3)
    streams.progress_stream(log, out, checkpoint).awaitTermination()
    return streams.read_progress(t.spark, out).select(
        "job_name", *progress.COUNTERS, F.round("items_per_second", 9).alias("items_per_second")
    )


@query("SELECT DISTINCT 'k' || CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type IN ('purchase', 'signup')")
def ttl_dedupe(t: Tables) -> DataFrame:
    """All events arrive in one batch, within which the watermark stands still: every key comes out exactly once."""
    entries = t.view("cache").select("key", F.col("created_at").cast("timestamp").alias("created_at"))
    events, out, checkpoint = stream_of(t, entries, "ttl-stream")
    first = streams.ttl_dedupe(events, "key", "created_at", "24 hours")
    streams.write_stream(first, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select("key")


@query(
    f"""WITH RECURSIVE entries AS (SELECT 'k' || CAST(user_id AS VARCHAR) AS key, event_id AS value, ts AS created_at
 FROM events WHERE event_type IN ('purchase', 'signup')),
misses AS (
 SELECT key, min(created_at) AS created_at FROM entries GROUP BY key
 UNION ALL SELECT m.key, min(e.created_at) FROM misses m JOIN entries e ON e.key = m.key AND e.created_at >= m.created_at + INTERVAL 24 HOUR
 GROUP BY m.key, m.created_at)
SELECT m.key, min(value) AS value, {q.time_text('m.created_at')} AS created_at
FROM misses m JOIN entries e ON e.key = m.key AND e.created_at = m.created_at GROUP BY m.key, m.created_at"""
)
def ttl_misses(t: Tables) -> DataFrame:
    """Entries that start a new lifetime. Slices of time arrive one after the other, each as files that all tasks wrote, one slice a micro-batch."""
    entries = t.view("cache").select("key", "value", F.col("created_at").cast("timestamp").alias("created_at"))
    base = shared_dir(t.spark, "ttl-misses")
    at = F.unix_micros("created_at")
    rows, first, last = entries.agg(F.count("*"), F.min(at), F.max(at)).first()
    slices = max(3, -(-rows // SLICE_ROWS))
    cuts = entries.select(at.alias("at")).approxQuantile("at", [k / slices for k in range(1, slices)], 0.01 / slices)
    files = max(2, -(-rows // (slices * FILE_ROWS)))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = entries if low is None else entries.where(at >= low)
        part = part if high is None else part.where(at < high)
        part.repartition(files).write.mode("append").parquet(f"{base}/in")
    log = streams.parquet_stream(t.spark, f"{base}/in", ddl(entries), files_per_batch=files)
    # Events of a slice come in any order, so the watermark stays behind by the longest.
    ends = [first or 0, *cuts, last or 0]
    longest = int(max(b - a for a, b in zip(ends, ends[1:]))) // 1_000_000 + 1
    found = streams.ttl_misses(log, "key", "value", "created_at", 24 * 3600, f"{longest} seconds")
    streams.write_stream(found, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("key", "value", jobs.time_text("created_at"))


@query(jobs.ALERTS, "metrics")
def alert_stream(t: Tables) -> DataFrame:
    samples, out, checkpoint = stream_of(t, t.view("metrics"), "alert-stream")
    streams.alert_stream(samples, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).drop("ts")


@query("SELECT sample_id, memory_pct FROM metrics", "metrics")
def progress_log_stream(t: Tables) -> DataFrame:
    base = shared_dir(t.spark, "log-stream")
    writers.append_progress(t.view("metrics"), f"{base}/in")
    samples = streams.progress_log_stream(t.spark, f"{base}/in", "sample_id bigint, memory_pct bigint")
    streams.write_stream(samples, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


# -- whole jobs -------------------------------------------------------------

CLEAN = f"""{READ},
cleaned AS (SELECT * REPLACE ({q.normalize_url('website')} AS website) FROM listings WHERE website IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY country, {q.normalize_url('website')} ORDER BY row_id) = 1)"""


@query(f"WITH {CLEAN} SELECT * EXCLUDE (row_id) FROM cleaned", "contacts")
def clean_job(t: Tables) -> DataFrame:
    cleaned = flows.clean_job(t.spark, raw_folder(t))
    return cleaned.withColumn("country", country_of("source_file")).drop("source_file", "ordinal")


EXTRACTED = f"""{q.VALID_CONTACTS}, cells AS (SELECT website, {page_queries.CELLS} FROM valid_contacts),
extracted AS (SELECT s.row_id, s.name, s.main_category, s.phone, s.website, c.email, c.facebook, c.instagram, c.linkedin, c.x
 FROM sites s LEFT JOIN cells c ON c.website = s.website)"""


def extracted(t: Tables) -> dict[str, DataFrame]:
    return flows.extract_job(t.view("sites"), t.view("linked_pages"), "row_id", domains=t.view("domains"))


@query(f"WITH {EXTRACTED} SELECT * FROM extracted", "sites linked_pages domains")
def extract_job(t: Tables) -> DataFrame:
    return extracted(t)["data"]


@query(
    f"""WITH {EXTRACTED} SELECT count(*) AS companies, count(website) AS domains, count(email) AS valid_emails, count(phone) AS phones,
 count(facebook) + count(instagram) + count(linkedin) + count(x) AS social_networks FROM extracted""",
    "sites linked_pages domains",
)
def extract_job_statistics(t: Tables) -> DataFrame:
    return extracted(t)["statistics"]


RESUMED = f"""{EXTRACTED},
resumed AS (SELECT row_id, name, main_category, phone, website,
 CASE WHEN row_id % 3 = 0 THEN 'stored' || CAST(row_id AS VARCHAR) || '@x.net' ELSE email END AS email,
 CASE WHEN row_id % 3 <> 0 THEN facebook END AS facebook, CASE WHEN row_id % 3 <> 0 THEN instagram END AS instagram,
 CASE WHEN row_id % 3 <> 0 THEN linkedin END AS linkedin, CASE WHEN row_id % 3 <> 0 THEN x END AS x FROM extracted)"""


def resumed(t: Tables) -> dict[str, DataFrame]:
    """Every third row was completed by an earlier run, which stored an address for it."""
    listings = t.view("sites").withColumn("job_name", F.lit("job"))
    done = listings.where("row_id % 3 = 0")
    attempts = done.select("job_name", "row_id", F.lit(True).alias("success"))
    stored = done.select("row_id", F.concat(F.lit("stored"), "row_id", F.lit("@x.net")).alias("email"))
    for name in ("facebook", "instagram", "linkedin", "x"):
        stored = stored.withColumn(name, F.lit(None).cast("string"))
    return flows.extract_job(listings, t.view("linked_pages"), "row_id", domains=t.view("domains"), attempts=attempts, stored=stored)


@query(f"WITH {RESUMED} SELECT * FROM resumed", "sites linked_pages domains")
def extract_job_resumed(t: Tables) -> DataFrame:
    return resumed(t)["data"].select("row_id", "name", "main_category", "phone", "website", "email", "facebook", "instagram", "linkedin", "x")


@query(
    f"""WITH {RESUMED} SELECT count(*) AS companies, count(website) AS domains, count(email) AS valid_emails, count(phone) AS phones,
 count(facebook) + count(instagram) + count(linkedin) + count(x) AS social_networks FROM resumed""",
    "sites linked_pages domains",
)
def extract_job_resumed_statistics(t: Tables) -> DataFrame:
    return resumed(t)["statistics"]


@query(f"WITH {q.EXCLUDED} SELECT row_id, name, email, website FROM excluded", "contacts")
def exclusion_job(t: Tables) -> DataFrame:
    return flows.exclusion_job(contact_report(t), q.TOKENS)["data"].select("row_id", "name", "email", "website")


@query(f"WITH {q.EXCLUDED} {contact_queries.CONTACT_STATS}", "contacts")
def exclusion_job_statistics(t: Tables) -> DataFrame:
    return flows.exclusion_job(contact_report(t), q.TOKENS)["statistics"]


MASKED_STORED = f"WITH {contact_queries.SWEPT_SOURCE.replace('{source}', 'contacts')} SELECT {contact_queries.SWEPT_COLUMNS} FROM by_role"


@query(MASKED_STORED, "contacts")
def mask_job(t: Tables) -> DataFrame:
    return flows.mask_job(contact_report(t))["data"]


@query(
    f"""SELECT name, website, {q.mask_email(BLANK)} AS email, {q.mask_phone('phone')} AS phone, {q.mask_social('facebook')} AS facebook,
 {q.mask_vowels('address')} AS address FROM contacts""",
    "contacts",
)
def mask_file(t: Tables) -> DataFrame:
    columns = ["name", "website", "email", "phone", "facebook", "address"]
    folder = shared_dir(t.spark, "listing") + ".csv"
    writers.write_listings(t.contacts.select(columns), folder)
    return readers.read_listings(t.spark, flows.mask_file(t.spark, folder), columns)


@query(
    f"""SELECT c_custkey AS id, 'u' || repeat('*', length(CAST(c_custkey AS VARCHAR))) || '@y.org' AS email, c_mktsegment AS name,
 'b' || repeat('*', 2 + length(CAST(c_custkey AS VARCHAR))) || '@z.org' AS remark FROM customer"""
)
def mask_file_mixed(t: Tables) -> DataFrame:
    """Two files with the same columns in other places, and addresses in a column whose name says nothing."""
    folder = shared_dir(t.spark, "mixed") + ".csv"
    rows = t.table("customer").selectExpr(
        "c_custkey AS id", "concat('u', c_custkey, '@y.org') AS email", "c_mktsegment AS name", "concat('bob', c_custkey, '@z.org') AS remark"
    )
    writers.write_listings(rows.where("id % 2 = 0").select("email", "name", "id", "remark"), f"{folder}/one")
    writers.write_listings(rows.where("id % 2 = 1").select("name", "remark", "email", "id"), f"{folder}/two")
    masked = readers.read_as_written(t.spark, flows.mask_file(t.spark, folder))
    return masked.select(F.col("id").cast("bigint").alias("id"), "email", "name", "remark")


@query(MASKED_STORED, "contacts")
def mask_file_report(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "data") + ".parquet"
    t.contacts.write.parquet(folder)
    return t.spark.read.parquet(flows.mask_file(t.spark, folder))


@query(
    f"""WITH {q.EXCLUDED}, masked AS (SELECT * FROM excluded), {contact_queries.SWEPT_SOURCE.replace('{source}', 'masked')}
SELECT {contact_queries.SWEPT_COLUMNS.replace(contact_queries.swept('country') + ' AS country', 'country')} FROM by_role""",
    "contacts",
)
def auto_flow(t: Tables) -> DataFrame:
    return flows.auto_flow(t.contacts, q.TOKENS, "country")["data"]


@query(
    f"""WITH {q.EXCLUDED}, per AS (SELECT *, {q.split_emails('email', True)} AS es FROM excluded),
distinct_emails AS (SELECT country, count(DISTINCT e) AS n FROM (SELECT country, unnest(es) AS e FROM per) GROUP BY 1)
SELECT p.country, count(*) AS companies, any_value(coalesce(d.n, 0)) AS unique_emails, count(phone) AS phones, count(phone) AS mobile_phones,
 count(DISTINCT website) AS domains, count(DISTINCT nullif({q.url_host('website')}, '')) AS distinct_hosts,
 count(facebook) + count(instagram) + count(linkedin) + count(x) AS social_networks
FROM per p LEFT JOIN distinct_emails d ON d.country = p.country GROUP BY p.country""",
    "contacts",
)
def auto_flow_statistics(t: Tables) -> DataFrame:
    return flows.auto_flow(t.contacts, q.TOKENS, "country")["statistics"]


def auto_folder(t: Tables) -> dict[str, DataFrame]:
    return flows.auto_flow_folder(t.spark, mixed_files(t, shared_dir(t.spark, "auto-folder"), t.contacts), q.TOKENS)


AUTO_COLUMNS = ["name", "website", "email", "phone", "address"]


@query(
    f"""WITH {q.EXCLUDED}, masked AS (SELECT * FROM excluded), {contact_queries.SWEPT_SOURCE.replace('{source}', 'masked')}
SELECT row_id, {", ".join(f"{contact_queries.swept(c, c == 'email', c == 'phone')} AS {c}" for c in AUTO_COLUMNS)}, nullif(reviews, 'n/a') AS reviews FROM by_role""",
    "contacts",
)
def auto_flow_folder(t: Tables) -> DataFrame:
    """Every file of a folder with mixed headers; three broken files cost nothing but themselves."""
    return auto_folder(t)["data"].select(F.col("row_id").cast("bigint").alias("row_id"), *AUTO_COLUMNS, "reviews")


@query("SELECT kind, stage FROM (VALUES ('headless', 'header'), ('truncated', 'read'), ('binary', 'read')) AS t(kind, stage) WHERE (SELECT count(*) FROM supplier) > 0")
def auto_flow_errors(t: Tables) -> DataFrame:
    """What went wrong with which file of that folder."""
    return auto_folder(t)["errors"].select(F.regexp_extract("source_file", "/(headless|truncated|binary)/", 1).alias("kind"), "stage")


@query(f"WITH {READ} SELECT name, website, email, phone, address, reviews, country FROM listings", "contacts")
def read_mixed_folder(t: Tables) -> DataFrame:
    """Files of two headers in one scan."""
    rows = readers.read_listing_folder(t.spark, mixed_files(t, shared_dir(t.spark, "mixed"), t.contacts, broken=False))
    return rows.select("name", "website", "email", "phone", "address", "reviews", country_of("source_file"))


@query(
    """SELECT main_category AS sector, count(*) AS number_of_companies FROM contacts GROUP BY 1""",
    "contacts",
)
def report_views(t: Tables) -> DataFrame:
    report = flows.exclusion_job(contact_report(t), q.TOKENS)
    return flows.report_views(report, ["row_id"])["top_sectors"]


FLOW_TOKENS = [*q.TOKENS, "info@shop1"]


def _full_sql() -> str:
    sweep = contact_queries.swept
    social = ", ".join(f"{contact_queries.guarded_social(n)} AS {n}" for n in q.NETWORKS)
    unwanted = " OR ".join(f"contains(lower(e), '{w}')" for w in FLOW_TOKENS)
    kept = f"list_filter({q.split_emails('email')}, lambda e: NOT ({unwanted}))"
    columns = ["name", "website", "email", "phone", "address", "sector", "reviews", *q.NETWORKS]
    return f"""WITH {CLEAN}, {q.VALID_CONTACTS.replace('linked_pages', 'shop_pages')},
cells AS (SELECT website, {page_queries.CELLS} FROM valid_contacts),
joined AS (SELECT c.* EXCLUDE (email), e.* EXCLUDE (website) FROM cleaned c LEFT JOIN cells e ON e.website = c.website),
kept AS (SELECT * REPLACE ({q.join_list(kept)} AS email) FROM joined),
by_role AS (SELECT name, website, sector, reviews, CASE WHEN contains(email, '@') THEN {q.mask_email('email')} ELSE email END AS email,
 CASE WHEN regexp_matches(phone, '[0-9]') THEN {q.mask_phone('phone')} ELSE phone END AS phone, {q.mask_vowels('address')} AS address, {social} FROM kept)
SELECT {', '.join(f"{sweep(c, c == 'email', c == 'phone')} AS {c}" for c in columns)} FROM by_role"""


@query(_full_sql(), "contacts shop_pages domains")
def full_flow(t: Tables) -> DataFrame:
    out = shared_dir(t.spark, "full-flow")
    report = flows.full_flow(t.spark, raw_folder(t), t.view("shop_pages"), FLOW_TOKENS, out, t.view("domains"))
    return report["data"].drop("listing_id", "source_file", "ordinal")


@query(
    f"""SELECT seq AS id, category, '[' || category || '] ' || error_type || ': ' || error_msg || ' | URL: ' || url || ' | Operation: N/A' AS line,
 {jobs.RETRIABLE} AS retriable FROM (SELECT *, {jobs.CATEGORY} AS category FROM attempts WHERE NOT success)""",
    "attempts",
)
def error_log(t: Tables) -> DataFrame:
    """Errors of a run, written as log lines and classified from them."""
    folder = shared_dir(t.spark, "errors")
    jobs.error_log(t).select(
        "id", "type", "message", F.create_map(F.lit("url"), "url").alias("context"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
    ).write.json(folder)
    log = readers.read_progress_log(t.spark, folder, errors.LOG_SCHEMA)
    return errors.classify_errors(errors.errors_from_log(log)).select("id", "category", "line", "retriable")


@query(f"{jobs.ALERTS}", "metrics")
def host_samples(t: Tables) -> DataFrame:
    """Host samples, written as log lines and checked from them."""
    folder = shared_dir(t.spark, "host")
    kinds = ("memory", "cpu", "disk")
    t.view("metrics").select(
        "sample_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        *[F.struct(F.col(f"{k}_pct").cast("double").alias("percent")).alias(k) for k in kinds],
    ).write.json(folder)
    log = readers.read_progress_log(t.spark, folder, metrics.SAMPLE_SCHEMA)
    return metrics.metric_alerts(metrics.samples_from_log(log)).drop("ts")
