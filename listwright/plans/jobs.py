"""Queries on job logs: attempts, progress, errors, cache, host samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.config import CONNECTION_ERROR_TYPES, DRIVER_ERROR_TYPES, NETWORK_ERROR_CODES, TRANSIENT_TERMS
from listwright.functions import timing
from listwright.operators import attempts as attempt_ops
from listwright.operators import cache as cache_ops
from listwright.operators import dedupe, errors, metrics, progress
from listwright.plans import sqltext as q
from listwright.plans.fixtures import Tables
from listwright.plans.registry import query

AT = "2024-01-20 00:00:00"


def time_text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def job_rows(t: Tables) -> DataFrame:
    """All planned rows of both jobs."""
    return t.attempts.select("job_name", "row_id", "url").distinct()


STATE = """marks AS (SELECT job_name, row_id, min(seq) FILTER (WHERE success) AS first_success, max(seq) FILTER (WHERE NOT success) AS last_failure
 FROM attempts GROUP BY 1, 2),
state AS (SELECT *, first_success IS NOT NULL AS completed,
 last_failure IS NOT NULL AND (first_success IS NULL OR last_failure > first_success) AS failed FROM marks)"""


@query(f"WITH {STATE} SELECT job_name, row_id, completed, failed FROM state", "attempts")
def attempt_state(t: Tables) -> DataFrame:
    return attempt_ops.attempt_state(t.attempts).select("job_name", "row_id", "completed", "failed")


@query(
    """SELECT DISTINCT job_name, row_id, url FROM attempts a
WHERE NOT EXISTS (SELECT 1 FROM attempts b WHERE b.success AND b.job_name = a.job_name AND b.row_id = a.row_id)""",
    "attempts",
)
def pending_rows(t: Tables) -> DataFrame:
    return attempt_ops.pending_rows(job_rows(t), t.attempts)


@query("SELECT DISTINCT job_name, row_id FROM attempts WHERE success", "attempts")
def completed_rows(t: Tables) -> DataFrame:
    return attempt_ops.completed_rows(t.attempts)


@query(
    """WITH planned AS (SELECT 'jobA' AS job_name, o_orderkey AS row_id, 'https://shop' || CAST(o_orderkey AS VARCHAR) || '.net' AS url FROM orders)
SELECT * FROM planned p WHERE EXISTS (SELECT 1 FROM attempts b WHERE b.job_name = p.job_name AND b.url = p.url)""",
    "attempts",
)
def processed_rows(t: Tables) -> DataFrame:
    """Planned rows whose address was visited, whatever came of it."""
    planned = t.table("orders").select(
        F.lit("jobA").alias("job_name"), F.col("o_orderkey").alias("row_id"), F.format_string("https://shop%s.net", F.col("o_orderkey").cast("string")).alias("url"),
    )
    return attempt_ops.processed_rows(planned, t.attempts)


@query(
    f"""WITH {STATE} SELECT s.job_name, s.row_id, a.url, a.error_type || ': ' || a.error_msg AS error, {q.time_text('a.ts')} AS failed_at
FROM state s JOIN attempts a ON a.job_name = s.job_name AND a.row_id = s.row_id AND a.seq = s.last_failure WHERE s.failed""",
    "attempts",
)
def failed_rows(t: Tables) -> DataFrame:
    return attempt_ops.failed_rows(t.attempts).select("job_name", "row_id", "url", "error", time_text("failed_at"))


RESULTS = """results AS (SELECT job_name, row_id, url, result FROM attempts WHERE success
 QUALIFY row_number() OVER (PARTITION BY job_name, row_id ORDER BY seq DESC) = 1)"""


@query(f"WITH {RESULTS} SELECT job_name, row_id, url, result FROM results", "attempts")
def stored_results(t: Tables) -> DataFrame:
    return attempt_ops.stored_results(t.attempts, ["url", "result"])


@query(
    f"""WITH {RESULTS}
SELECT job_name, row_id, url, result, FALSE AS fresh FROM results
UNION ALL SELECT DISTINCT job_name, row_id, url, -1.0 AS result, TRUE FROM attempts a
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.job_name = a.job_name AND r.row_id = a.row_id)""",
    "attempts",
)
def resume_merge(t: Tables) -> DataFrame:
    stored = stored_results(t).withColumn("fresh", F.lit(False))
    return attempt_ops.resume_merge(
        job_rows(t), t.attempts, stored,
        lambda rows: rows.withColumn("result", F.lit(-1.0)).withColumn("fresh", F.lit(True)),
    )


@query(
    """SELECT url, job_name, seq, success FROM attempts
QUALIFY row_number() OVER (PARTITION BY url, job_name ORDER BY seq DESC) = 1""",
    "attempts",
)
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.attempts.select("url", "job_name", "seq", "success")
    return dedupe.latest_per_key(rows, ["url", "job_name"], F.col("seq"))


@query(
    f"""WITH {STATE}, spans AS (SELECT job_name, row_id, min(ts) AS lo, max(ts) AS hi FROM attempts GROUP BY 1, 2)
SELECT job_name, count(*) AS total, count(*) FILTER (WHERE completed) AS completed, count(*) FILTER (WHERE failed) AS failed,
 count(*) FILTER (WHERE NOT completed) AS pending, round(count(*) FILTER (WHERE completed) / count(*) * 100, 6) AS percent_complete,
 max(row_id) + 1 AS position, {q.time_text('min(lo)')} AS started_at, {q.time_text('max(hi)')} AS last_updated,
 round((epoch_us(max(hi)) - epoch_us(min(lo))) / 1e6, 6) AS elapsed_seconds, count(*) FILTER (WHERE NOT completed) = 0 AS is_completed
FROM state JOIN spans USING (job_name, row_id) GROUP BY job_name""",
    "attempts",
)
def job_progress(t: Tables) -> DataFrame:
    p = attempt_ops.job_progress(t.attempts)
    return p.select(
        "job_name", "total", "completed", "failed", "pending",
        F.round("percent_complete", 6).alias("percent_complete"), "position",
        time_text("started_at"), time_text("last_updated"),
        F.round("elapsed_seconds", 6).alias("elapsed_seconds"), "is_completed",
    )


THROUGHPUT = """counters AS (SELECT job_name, count(*) AS processed_items, count(*) FILTER (WHERE success AND NOT skipped) AS successful_items,
 count(*) FILTER (WHERE NOT success AND NOT skipped) AS failed_items, count(*) FILTER (WHERE skipped) AS skipped_items,
 (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_time FROM attempts GROUP BY job_name),
speed AS (SELECT *, CASE WHEN elapsed_time > 0 THEN processed_items / elapsed_time ELSE 0.0 END AS items_per_second FROM counters)"""


def duration_sql(s: str) -> str:
    return (
        f"CASE WHEN {s} < 60 THEN printf('%.1fs', {s}) WHEN {s} < 3600 THEN printf('%.1fm', {s} / 60)"
        f" ELSE printf('%.1fh', {s} / 3600) END"
    )


@query(
    f"""WITH {THROUGHPUT}, eta AS (SELECT *, CASE WHEN items_per_second > 0 THEN (2000000 - processed_items) / items_per_second ELSE 0.0 END AS estimated_remaining FROM speed)
SELECT job_name, 2000000 AS total_items, processed_items, successful_items, failed_items, skipped_items, round(elapsed_time, 6) AS elapsed_time,
 round(items_per_second, 9) AS items_per_second, round(estimated_remaining, 3) AS estimated_remaining,
 round(processed_items / 2000000 * 100, 6) AS percent_complete, {duration_sql('elapsed_time')} AS elapsed_text FROM eta""",
    "attempts",
)
def throughput(t: Tables) -> DataFrame:
    out = progress.throughput(t.attempts, total_items=2_000_000)
    return out.select(
        "job_name", "total_items", *progress.COUNTERS, F.round("elapsed_time", 6).alias("elapsed_time"),
        F.round("items_per_second", 9).alias("items_per_second"),
        F.round("estimated_remaining", 3).alias("estimated_remaining"),
        F.round("percent_complete", 6).alias("percent_complete"), "elapsed_text",
    )


@query(f"SELECT event_id, {duration_sql('CAST(event_id AS DOUBLE)')} AS shown, {duration_sql('value')} AS value_shown FROM events")
def format_duration(t: Tables) -> DataFrame:
    return t.table("events").select(
        "event_id",
        timing.format_duration(F.col("event_id").cast("double")).alias("shown"),
        timing.format_duration(F.col("value")).alias("value_shown"),
    )


# -- errors -----------------------------------------------------------------


def error_log(t: Tables) -> DataFrame:
    return t.attempts.where("NOT success").select(
        F.col("seq").alias("id"), F.col("error_type").alias("type"), F.col("error_msg").alias("message"),
        "url", F.lit("extract").alias("operation"), "ts",
    )


def in_list(column: str, values: list[str]) -> str:
    return f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


NETWORK = f"({in_list('error_type', CONNECTION_ERROR_TYPES)} OR regexp_matches(error_msg, '{'|'.join(NETWORK_ERROR_CODES)}'))"
CATEGORY = f"CASE WHEN {NETWORK} THEN 'NETWORK' WHEN error_type IN ('NoSuchElementException', 'StaleElementReferenceException') THEN 'DOM' ELSE 'GENERAL' END"
RETRIABLE = f"({in_list('error_type', CONNECTION_ERROR_TYPES)} OR ({in_list('error_type', DRIVER_ERROR_TYPES)} AND regexp_matches(lower(error_msg), '{'|'.join(TRANSIENT_TERMS)}')))"


@query(
    f"""SELECT seq AS id, category, CASE category WHEN 'NETWORK' THEN 'warning' WHEN 'DOM' THEN 'info' ELSE 'error' END AS severity,
 '[' || category || '] ' || error_type || ': ' || error_msg || ' | URL: ' || url || ' | Operation: extract' AS line
FROM (SELECT *, {CATEGORY} AS category FROM attempts WHERE NOT success)""",
    "attempts",
)
def classify_error(t: Tables) -> DataFrame:
    return errors.classify_errors(error_log(t)).select("id", "category", "severity", "line")


@query(f"SELECT seq AS id, {RETRIABLE} AS retriable FROM attempts WHERE NOT success", "attempts")
def is_retriable(t: Tables) -> DataFrame:
    return errors.classify_errors(error_log(t)).select("id", "retriable")


@query("SELECT error_type AS type, count(*) AS errors FROM attempts WHERE NOT success GROUP BY 1", "attempts")
def error_counts(t: Tables) -> DataFrame:
    return errors.error_counts(error_log(t))


@query(
    """WITH c AS (SELECT error_type AS type, count(*) AS n FROM attempts WHERE NOT success GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_errors, count(*) AS error_types,
 (SELECT type FROM c ORDER BY n DESC, type LIMIT 1) AS most_common_error, CAST(least(sum(n), 100) AS BIGINT) AS recent_errors_count FROM c""",
    "attempts",
)
def error_summary(t: Tables) -> DataFrame:
    return errors.error_summary(error_log(t))


@query("SELECT seq AS id, error_type AS type, error_msg AS message FROM attempts WHERE NOT success ORDER BY ts DESC, seq DESC LIMIT 100", "attempts")
def recent_errors(t: Tables) -> DataFrame:
    return errors.recent_errors(error_log(t)).select("id", "type", "message")


# -- cache ------------------------------------------------------------------

LOOKUP = """lookups AS (SELECT r.req_id, r.key, coalesce(c.expires_at > r.req_ts, FALSE) AS hit, c.value, c.created_at
 FROM requests r LEFT JOIN cache c ON c.key = r.key AND c.created_at <= r.req_ts
 QUALIFY row_number() OVER (PARTITION BY r.req_id ORDER BY c.created_at DESC, c.value DESC) = 1)"""


def lookups(t: Tables) -> DataFrame:
    return cache_ops.cache_lookup(t.view("requests"), t.view("cache"))


@query(f"WITH {LOOKUP} SELECT req_id, key, hit, CASE WHEN hit THEN value END AS value FROM lookups", "requests cache")
def cache_lookup(t: Tables) -> DataFrame:
    return lookups(t).select("req_id", "key", "hit", "value")


@query(
    f"""WITH {LOOKUP} SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
 (SELECT count(*) FROM (SELECT DISTINCT key, created_at FROM lookups WHERE NOT hit AND created_at IS NOT NULL)) AS items_expired,
 (SELECT count(DISTINCT key) FROM cache) AS item_count, round(count(*) FILTER (WHERE hit) / count(*), 9) AS hit_ratio FROM lookups""",
    "requests cache",
)
def cache_stats(t: Tables) -> DataFrame:
    out = cache_ops.cache_stats(lookups(t), t.view("cache"))
    return out.withColumn("hit_ratio", F.round("hit_ratio", 9))


def _at() -> Column:
    return F.lit(AT).cast("timestamp")


@query(f"SELECT key, value FROM cache WHERE expires_at > TIMESTAMP '{AT}'", "cache")
def live_entries(t: Tables) -> DataFrame:
    return cache_ops.live_entries(t.view("cache"), _at()).select("key", "value")


@query(f"SELECT key, value FROM cache WHERE expires_at <= TIMESTAMP '{AT}'", "cache")
def expired_entries(t: Tables) -> DataFrame:
    return cache_ops.expired_entries(t.view("cache"), _at()).select("key", "value")


@query(
    "SELECT key, value FROM cache QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, value DESC) = 1", "cache"
)
def current_entries(t: Tables) -> DataFrame:
    return cache_ops.current_entries(t.view("cache")).select("key", "value")


@query(
    """SELECT event_id, strftime(ts + INTERVAL 1 SECOND * CASE WHEN event_id % 3 = 0 THEN 3600 WHEN event_id % 5 = 0 THEN 3600 ELSE event_id % 1000 + 1 END,
 '%Y-%m-%d %H:%M:%S.%f') AS expires_at FROM events"""
)
def expiry(t: Tables) -> DataFrame:
    ttl = F.expr("CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 1000 + 1 END")
    rows = t.table("events").withColumn("expires_at", timing.expiry(F.col("ts"), ttl))
    return rows.select("event_id", time_text("expires_at"))


# -- host samples -----------------------------------------------------------


def _alert_sql(kind: str, limit: int, message: str) -> str:
    return (
        f"SELECT sample_id, '{kind}' AS type, 'warning' AS level, '{message}' || printf('%.1f', CAST({kind}_pct AS DOUBLE)) || '%' AS message"
        f" FROM metrics WHERE {kind}_pct > {limit}"
    )


ALERTS = " UNION ALL ".join(
    _alert_sql(*a) for a in [("memory", 80, "High memory use: "), ("cpu", 70, "High CPU use: "), ("disk", 90, "Low disk space: ")]
)


@query(ALERTS, "metrics")
def metric_alerts(t: Tables) -> DataFrame:
    return metrics.metric_alerts(t.view("metrics")).drop("ts")


@query(
    """SELECT max(memory_pct) AS peak_memory_pct, max(cpu_pct) AS peak_cpu_pct, count(*) FILTER (WHERE memory_pct > 80) AS memory_warnings,
 count(*) FILTER (WHERE cpu_pct > 70) AS cpu_warnings, count(*) FILTER (WHERE memory_pct > 80 OR cpu_pct > 70) AS throttle_events FROM metrics""",
    "metrics",
)
def peak_metrics(t: Tables) -> DataFrame:
    return metrics.peak_metrics(t.view("metrics"))
