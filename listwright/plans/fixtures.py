"""Views that give the driver's tables the shapes the operators work on.

The same text runs in Spark and in the SQL check; ``{table}`` is filled in.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Page text with addresses and links in front of the real text.
LINKED_HTML = """'<p>Info@shop' || CAST(page_id AS STRING) || '.net desk@mail.net, a@b.c_d@e.fg</p><a href="https://www.facebook.com/p' || CAST(page_id AS STRING) || '">f</a><A class=z HREF=''https://facebook.com/sharer?u=x.com/a''>s</A><a href="https://netflix.com/t' || CAST(page_id % 5 AS STRING) || '">n</a><a href="https://www.linkedin.com/company/c' || CAST(page_id AS STRING) || '">l</a><a href="https://www.linkedin.com/feed">l</a><a href="https://twitter.com/intent/t">t</a>' || html"""

VIEWS = {
    "contacts": """
SELECT c_custkey AS row_id, c_name AS name, c_mktsegment AS main_category, n_name AS country,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE ' WWW.Shop' || CAST(c_custkey % 400 AS STRING) || '.net/Home Page ' END AS website,
 CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 4 THEN ''
  WHEN 1 THEN 'info@shop' || CAST(c_custkey % 400 AS STRING) || '.net'
  WHEN 2 THEN 'sales@shop' || CAST(c_custkey AS STRING) || '.net; Legal@shop' || CAST(c_custkey AS STRING) || '.net'
  WHEN 3 THEN 'Ana.' || CAST(c_custkey AS STRING) || '@mail.net, , hi@mail.net'
  ELSE 'noreply@shop' || CAST(c_custkey AS STRING) || '.net,desk@shop' || CAST(c_custkey AS STRING) || '.net' END AS email,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '+34 600 ' || lpad(CAST(c_custkey AS STRING), 6, '0') END AS phone,
 CASE WHEN c_custkey % 3 = 0 THEN 'https://facebook.com/shop' || CAST(c_custkey AS STRING) END AS facebook,
 CASE WHEN c_custkey % 5 = 0 THEN 'https://instagram.com/s' || CAST(c_custkey AS STRING) || '/' END AS instagram,
 CASE WHEN c_custkey % 8 = 0 THEN 'https://linkedin.com/company/c' || CAST(c_custkey AS STRING) END AS linkedin,
 CASE WHEN c_custkey % 10 = 0 THEN 'https://x.com/h' || CAST(c_custkey AS STRING) END AS x,
 'Calle ' || c_mktsegment || ' ' || CAST(c_custkey AS STRING) AS address,
 CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_custkey % 500 AS STRING) END AS reviews
FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey""",
    "domains": """
SELECT 'shop' || CAST(c_custkey AS STRING) || '.net' AS domain, c_custkey % 3 <> 0 AS domain_exists, c_custkey % 4 <> 0 AS mx_exists FROM {customer}
UNION ALL SELECT 'mail.net', TRUE, TRUE""",
    "word_table": """
SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN '@shop' || CAST(c_custkey AS STRING) || '.' WHEN 1 THEN ' ANA.' || CAST(c_custkey AS STRING) || ' '
 WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE 'ana.' || CAST(c_custkey AS STRING) END AS token
FROM {customer}""",
    "few_words": """
SELECT DISTINCT CASE WHEN n_nationkey % 4 = 0 THEN ' Info ' WHEN n_nationkey % 4 = 1 THEN 'LEGAL' WHEN n_nationkey % 4 = 2 THEN NULL
 ELSE ' Ana.' || CAST(n_nationkey AS STRING) END AS token
FROM {nation}""",
    "attempts": """
SELECT CASE WHEN event_id % 2 = 0 THEN 'jobA' ELSE 'jobB' END AS job_name,
 CAST(floor(event_id / 6.0) AS BIGINT) AS row_id, event_id AS seq, ts,
 'https://shop' || CAST(CAST(floor(event_id / 6.0) AS BIGINT) AS STRING) || '.net' AS url,
 event_type NOT IN ('error','view') AS success,
 CASE WHEN event_type = 'error' THEN 'TimeoutException' WHEN event_type = 'view' THEN
  CASE event_id % 3 WHEN 0 THEN 'NoSuchElementException' WHEN 1 THEN 'ValueError' ELSE 'WebDriverException' END END AS error_type,
 CASE WHEN event_type = 'error' THEN 'page timeout' WHEN event_type = 'view' THEN
  CASE event_id % 4 WHEN 0 THEN 'net::ERR_NAME_NOT_RESOLVED' WHEN 1 THEN 'connection reset' ELSE 'bad value' END END AS error_msg,
 value AS result, event_type = 'signup' AS skipped
FROM {events}""",
    "cache": """
SELECT 'k' || CAST(user_id AS STRING) AS key, event_id AS value, ts AS created_at, ts + INTERVAL '24' HOUR AS expires_at
FROM {events} WHERE event_type IN ('purchase','signup')""",
    "requests": """
SELECT event_id AS req_id, 'k' || CAST(user_id AS STRING) AS key, ts AS req_ts FROM {events} WHERE event_type = 'click'""",
    "linked_pages": f"""
SELECT page_id, url, {LINKED_HTML} AS html FROM {{pages}}""",
    "shop_pages": f"""
SELECT page_id, 'https://www.shop' || CAST(page_id AS STRING) || '.net/homepage' AS url, {LINKED_HTML} AS html FROM {{pages}}""",
    "sites": """
SELECT c_custkey AS row_id, c_name AS name, c_mktsegment AS main_category, 'old@mail.net' AS email,
 '+34 600 ' || lpad(CAST(c_custkey AS STRING), 6, '0') AS phone,
 CASE WHEN c_custkey % 11 = 0 THEN 'ftp://nowhere' ELSE url END AS website
FROM {customer} LEFT JOIN {pages} ON page_id = CAST(floor(c_custkey / 6.0) AS BIGINT)""",
    "metrics": """
SELECT event_id AS sample_id, ts, event_id % 101 AS memory_pct, (event_id * 7) % 101 AS cpu_pct, (event_id * 13) % 101 AS disk_pct FROM {events}""",
    "files": """
SELECT source || '/' || CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.log' WHEN 1 THEN '.tmp' WHEN 2 THEN '.JPG' ELSE '.csv' END AS path,
 source AS folder, CAST(length(text) AS BIGINT) AS length, md5(text) AS content_md5, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * doc_id AS mtime FROM {documents}""",
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """The driver's tables and the views on them, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
        return self.spark.sql(VIEWS[name], **used)

    @cached_property
    def contacts(self) -> DataFrame:
        return self.view("contacts")

    @cached_property
    def attempts(self) -> DataFrame:
        return self.view("attempts")

    @cached_property
    def files(self) -> DataFrame:
        return self.view("files")


def with_views(body: str, *views: str) -> str:
    """SQL text for the check: the views as common table expressions, then the body."""
    plain = {t: t for t in TABLES}
    ctes = [f"{v} AS ({VIEWS[v].format(**plain)}\n)" for v in views]
    if not ctes:
        return body
    inner = body.strip()
    if inner.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + inner[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + inner
