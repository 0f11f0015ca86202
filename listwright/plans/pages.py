"""Queries on pages and documents: addresses, links, copies, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import patterns, social, text
from listwright.functions.timing import age_days as age_in_days
from listwright.operators import contacts as contact_ops
from listwright.operators import dedupe, files
from listwright.plans import sqltext as q
from listwright.plans.fixtures import Tables
from listwright.plans.registry import query
from listwright.session import materialize, shared_dir
from listwright.sources.file_digests import copies
from listwright.sources import readers, writers

AT = "2024-02-01 00:00:00"


def at() -> Column:
    return F.lit(AT).cast("timestamp")


@query(f"SELECT doc_id, array_to_string({q.extract_emails('text')}, '|') AS emails FROM documents")
def extract_emails(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", F.array_join(text.extract_emails(F.col("text")), "|").alias("emails"))


@query(
    rf"""SELECT page_id, array_to_string(list_transform({q.extract_emails('html')}, lambda e: regexp_replace(e, '\.+$', '')), '|') AS emails FROM linked_pages""",
    "linked_pages",
)
def extract_emails_trim_dot(t: Tables) -> DataFrame:
    found = text.extract_emails(F.col("html"), trim_dot=True)
    return t.view("linked_pages").select("page_id", F.array_join(found, "|").alias("emails"))


@query(f"SELECT page_id, array_to_string({q.extract_links('html')}, '|') AS links FROM linked_pages", "linked_pages")
def extract_links(t: Tables) -> DataFrame:
    return t.view("linked_pages").select("page_id", F.array_join(text.extract_links(F.col("html")), "|").alias("links"))


@query(
    f"""WITH l AS (SELECT page_id, url, {q.extract_links('html')} AS raw FROM pages)
SELECT page_id, array_to_string(list_transform(raw, lambda h: {q.resolve('h', 'url')}), '|') AS links FROM l""",
)
def resolve_links(t: Tables) -> DataFrame:
    links = text.resolve_links(text.extract_links(F.col("html")), F.col("url"))
    return t.table("pages").select("page_id", F.array_join(links, "|").alias("links"))


def _links(t: Tables) -> DataFrame:
    return t.view("linked_pages").select("page_id", F.explode(text.extract_links(F.col("html"))).alias("link"))


LINKS = f"links AS (SELECT page_id, unnest({q.extract_links('html')}) AS link FROM linked_pages)"


@query(
    f"WITH {LINKS} SELECT page_id, link, {', '.join(q.is_network('link', n) + ' AS is_' + n for n in q.NETWORKS)}, {q.social_class('link')} AS network FROM links",
    "linked_pages",
)
def social_class(t: Tables) -> DataFrame:
    link = F.col("link")
    return _links(t).select(
        "page_id", "link",
        *[social.is_network(link, n).alias(f"is_{n}") for n in social.RULES],
        social.social_class(link).alias("network"),
    )


@query(
    f"""WITH {LINKS}, tagged AS (SELECT page_id, link, regexp_extract(link, '^https?://([^/?#:]*)', 1) AS host FROM links)
SELECT page_id, link, coalesce(
 (host = 'x.com' OR host LIKE '%.x.com' OR host = 'twitter.com' OR host LIKE '%.twitter.com') AND NOT contains(link, 'share') AND NOT contains(link, 'intent') AND length(link) < 100,
 FALSE) AS on_x FROM tagged""",
    "linked_pages",
)
def is_x_strict_host(t: Tables) -> DataFrame:
    return _links(t).withColumn("on_x", social.is_network(F.col("link"), "x", strict_host=True))


@query(
    f"""WITH l AS (SELECT page_id, {q.extract_links('html')} AS links FROM linked_pages)
SELECT page_id, {', '.join("array_to_string(" + q.classified('links', n) + ", ', ') AS " + n for n in q.NETWORKS)} FROM l""",
    "linked_pages",
)
def classify_social(t: Tables) -> DataFrame:
    found = t.view("linked_pages").withColumn("s", social.classify_social(text.extract_links(F.col("html"))))
    return found.select("page_id", *[F.array_join(f"s.{n}", ", ").alias(n) for n in social.RULES])


CELLS = ", ".join(q.join_list(c) + f" AS {c}" for c in ["email", *q.NETWORKS])


@query(f"WITH {q.PAGE_CONTACTS} SELECT website, {CELLS} FROM page_contacts", "linked_pages")
def extract_contacts(t: Tables) -> DataFrame:
    return contact_ops.contact_cells(contact_ops.extract_contacts(t.view("linked_pages")))


@query(f"WITH {q.VALID_CONTACTS} SELECT website, {CELLS} FROM valid_contacts", "linked_pages domains")
def verified_contacts(t: Tables) -> DataFrame:
    contacts = materialize(contact_ops.extract_contacts(t.view("linked_pages")), "contacts")
    return contact_ops.contact_cells(contact_ops.verified_contacts(contacts, t.view("domains")))


@query(
    f"""WITH {q.PAGE_CONTACTS}, cells AS (SELECT website, {CELLS} FROM page_contacts)
SELECT s.row_id, s.name, s.main_category, s.phone, s.website, c.email, c.facebook, c.instagram, c.linkedin, c.x
FROM sites s LEFT JOIN cells c ON c.website = s.website""",
    "linked_pages sites",
)
def attach_contacts(t: Tables) -> DataFrame:
    contacts = contact_ops.extract_contacts(t.view("linked_pages"))
    return contact_ops.attach_contacts(t.view("sites"), contacts, "row_id")


WORDS = "string_split(text, ' ')"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({WORDS})), '|') AS words FROM documents")
def distinct_values(t: Tables) -> DataFrame:
    words = text.distinct_values(F.split("text", " "))
    return t.table("documents").select("doc_id", F.array_join(words, "|").alias("words"))


@query(f"SELECT doc_id, {q.join_list(WORDS)} AS words FROM documents")
def join_list(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", text.join_list(F.split("text", " ")).alias("words"))


@query("SELECT doc_id, md5(text) AS content_md5 FROM documents")
def content_md5(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", text.content_md5(F.col("text")).alias("content_md5"))


@query(
    r"""SELECT path, lower(regexp_extract(path, '[^.](\.[^./]+)$', 1)) AS extension, split_part(path, '/', -1) AS base_name FROM files""", "files"
)
def file_extension(t: Tables) -> DataFrame:
    return t.files.select(
        "path",
        text.file_extension(F.col("path")).alias("extension"),
        text.base_name(F.col("path")).alias("base_name"),
    )


# -- copies -----------------------------------------------------------------


@query(
    """SELECT length, content_md5, count(*) AS copies, min(path) AS first_path, CAST(length * (count(*) - 1) AS BIGINT) AS redundant_bytes
FROM files WHERE length > 0 GROUP BY length, content_md5 HAVING count(*) > 1""",
    "files",
)
def duplicate_groups(t: Tables) -> DataFrame:
    return dedupe.duplicate_groups(t.files.where("length > 0"))


@query(
    """SELECT path, content_md5 FROM files WHERE length > 0
QUALIFY count(*) OVER (PARTITION BY length, content_md5) > 1""",
    "files",
)
def duplicate_members(t: Tables) -> DataFrame:
    return dedupe.duplicate_members(t.files.where("length > 0")).select("path", "content_md5")


@query(
    """SELECT path, content_md5 FROM files WHERE length > 0
QUALIFY row_number() OVER (PARTITION BY length, content_md5 ORDER BY mtime DESC, path) > 1""",
    "files",
)
def duplicates_to_drop(t: Tables) -> DataFrame:
    return dedupe.duplicates_to_drop(t.files.where("length > 0")).select("path", "content_md5")


@query(
    """SELECT path, content_md5 FROM files WHERE length > 0
QUALIFY row_number() OVER (PARTITION BY length, content_md5 ORDER BY path) > 1""",
    "files",
)
def duplicates_to_drop_keep_first(t: Tables) -> DataFrame:
    return dedupe.duplicates_to_drop(t.files.where("length > 0"), keep="first").select("path", "content_md5")


@query(
    """SELECT doc_id, lang FROM documents WHERE length(text) > 0
QUALIFY row_number() OVER (PARTITION BY length(text), md5(text) ORDER BY doc_id DESC) > 1"""
)
def duplicate_documents(t: Tables) -> DataFrame:
    docs = t.table("documents").select(
        F.col("doc_id").alias("path"), "lang", F.length("text").alias("length"), F.col("text").alias("content"),
        F.timestamp_seconds("doc_id").alias("mtime"),
    )
    return dedupe.duplicates_to_drop(dedupe.with_fingerprint(docs)).select(F.col("path").alias("doc_id"), "lang")


# -- retention --------------------------------------------------------------


@query(
    f"""SELECT path, folder FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY mtime DESC, path) AS rk FROM files)
WHERE rk > 5 AND (epoch_us(TIMESTAMP '{AT}') - epoch_us(mtime)) / 86400e6 >= 7""",
    "files",
)
def retention_candidates(t: Tables) -> DataFrame:
    return files.retention_candidates(t.files, at(), group=["folder"]).select("path", "folder")


@query(
    f"""SELECT path FROM (SELECT *, row_number() OVER (ORDER BY mtime DESC, path) AS rk FROM files WHERE path LIKE '%.log')
WHERE rk > 5 AND (epoch_us(TIMESTAMP '{AT}') - epoch_us(mtime)) / 86400e6 >= 7""",
    "files",
)
def retention_candidates_one_folder(t: Tables) -> DataFrame:
    logs = t.files.where(F.col("path").endswith(".log"))
    return files.retention_candidates(logs, at()).select("path")


@query(
    f"""SELECT path FROM files WHERE regexp_matches(path, '(^|/)([^/]*\\.(tmp|temp|bak|old|pyc|swp|swo|cache)|[^/]*\\.log\\.[^/]*|__pycache__|~[^/]*)$')
 AND (epoch_us(TIMESTAMP '{AT}') - epoch_us(mtime)) / 86400e6 >= 1""",
    "files",
)
def temp_files(t: Tables) -> DataFrame:
    return files.temp_files(t.files, at(), max_age_days=1).select("path")


@query("SELECT path, regexp_matches(path, '(^|/)([^/]*\\.tmp|[^/]*\\.log|src1/[0-4][^/]*)$') AS matches FROM files", "files")
def matches_patterns(t: Tables) -> DataFrame:
    globs = ["*.tmp", "*.log", "src1/[0-4]*"]
    return t.files.select("path", patterns.matches_patterns(F.col("path"), globs).alias("matches"))


@query(
    f"SELECT path FROM files WHERE (epoch_us(TIMESTAMP '{AT}') - epoch_us(mtime)) / 86400e6 >= 10", "files"
)
def older_than(t: Tables) -> DataFrame:
    return files.older_than(t.files, at(), 10).select("path")


@query(f"SELECT path, round((epoch_us(TIMESTAMP '{AT}') - epoch_us(mtime)) / 86400e6, 6) AS age_days FROM files", "files")
def age_days(t: Tables) -> DataFrame:
    return t.files.select("path", F.round(age_in_days(F.col("mtime"), at()), 6).alias("age_days"))


NAMED = "CASE WHEN doc_id % 3 = 0 THEN source || '/README.md' WHEN doc_id % 3 = 1 THEN source || '/config.json' ELSE source || '/' || CAST(doc_id AS VARCHAR) || '.json' END"


@query(f"SELECT doc_id, {NAMED} AS path FROM documents WHERE doc_id % 3 = 2")
def not_preserved(t: Tables) -> DataFrame:
    """The names that are always kept, by the default list."""
    named = t.table("documents").selectExpr("doc_id", f"{NAMED.replace('VARCHAR', 'STRING')} AS path")
    return named.where(patterns.not_preserved(F.col("path")))


# -- sources that are read as they are --------------------------------------


@query("SELECT page_id, url, html FROM pages")
def pages(t: Tables) -> DataFrame:
    return readers.read_pages(t.spark, f"{t.sf_dir}/pages.parquet")


@query(
    """SELECT c_nationkey AS folder, CAST(sum(length(c_name) + 1) AS BIGINT) AS length,
 md5(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS content_md5 FROM customer GROUP BY 1"""
)
def file_inventory(t: Tables) -> DataFrame:
    """One file for each nation with the names of its customers, found again by size and hash."""
    folder = shared_dir(t.spark, "inventory")
    names = t.table("customer").select(F.col("c_nationkey").cast("bigint").alias("folder"), "c_custkey", F.col("c_name").alias("value"))
    ordered = names.repartition("folder").sortWithinPartitions("folder", "c_custkey")
    ordered.select("folder", "value").write.partitionBy("folder").text(folder)
    found = readers.file_inventory(t.spark, folder, [".txt"], hashed=True)
    return found.select(F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("bigint").alias("folder"), "length", "content_md5")


@query(
    """WITH f AS (SELECT c_nationkey AS folder, CAST(sum(length(c_name) + 1) AS BIGINT) AS length,
 md5(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS content_md5 FROM customer GROUP BY 1)
SELECT copy, folder, length, content_md5 FROM f, (VALUES ('one'), ('two')) AS t(copy) WHERE folder % 3 = 0"""
)
def duplicate_files(t: Tables) -> DataFrame:
    """Files with a copy in another folder, by size, beginning and content; the other files have a line more or another line."""
    folder = shared_dir(t.spark, "copies")
    names = t.table("customer").select(F.col("c_nationkey").cast("bigint").alias("folder"), "c_custkey", F.col("c_name").alias("value"))
    edited = F.when(F.col("folder") % 3 == 0, F.col("value")).when(F.col("folder") % 3 == 1, F.reverse("value")).otherwise(F.concat("value", F.lit("+")))
    for copy, value in (("one", F.col("value")), ("two", edited)):
        ordered = names.withColumn("value", value).repartition("folder").sortWithinPartitions("folder", "c_custkey")
        ordered.select("folder", "value").write.partitionBy("folder").text(f"{folder}/{copy}")
    found = copies(readers.file_inventory(t.spark, folder, [".txt"]))
    return found.select(
        F.regexp_extract("path", "/(one|two)/", 1).alias("copy"), F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("bigint").alias("folder"), "length", "content_md5",
    )


@query(
    """SELECT doc_id, CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS INTEGER) AS line_no,
 unnest(string_split(text, chr(10))) AS line FROM documents"""
)
def notice_table(t: Tables) -> DataFrame:
    return writers.text_lines(t.table("documents").select("doc_id", "text"), "text")
