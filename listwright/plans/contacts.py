"""Queries on the contact table: word lists, statistics, columns, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import masks, text, verification
from listwright.operators import contacts as contact_ops
from listwright.operators import dedupe, exclusion, masking, schema, stats
from listwright.operators.ranks import with_place
from listwright.operators.verify import verify_emails
from listwright.plans import sqltext as q
from listwright.plans.fixtures import Tables
from listwright.plans.registry import query
from listwright.sources.readers import config_lines, parse_rename_map

ROW = ["row_id"]
SPLIT = q.split_emails("email")


def excluded(t: Tables) -> DataFrame:
    return exclusion.exclude_emails(t.contacts, q.TOKENS)


@query(f"SELECT row_id, CAST(len({SPLIT}) AS INTEGER) AS n, array_to_string({SPLIT}, '|') AS emails FROM contacts", "contacts")
def split_emails(t: Tables) -> DataFrame:
    emails = text.split_emails(F.col("email"))
    return t.contacts.select("row_id", F.size(emails).alias("n"), F.array_join(emails, "|").alias("emails"))


@query(f"SELECT row_id, {q.join_list(SPLIT)} AS email FROM contacts", "contacts")
def rejoin_emails(t: Tables) -> DataFrame:
    return t.contacts.select("row_id", text.rejoin_emails(text.split_emails(F.col("email"))).alias("email"))


@query(
    f"SELECT row_id, address, {q.unwanted('address')} AS excluded FROM (SELECT row_id, unnest({SPLIT}) AS address FROM contacts)",
    "contacts",
)
def is_excluded(t: Tables) -> DataFrame:
    rows = t.contacts.select("row_id", F.explode(text.split_emails(F.col("email"))).alias("address"))
    return rows.withColumn("excluded", exclusion.is_excluded(F.col("address"), q.TOKENS))


@query(
    f"""SELECT row_id, address, {' OR '.join("regexp_matches(lower(address), '(^|[^a-z0-9])" + w + "($|[^a-z0-9])')" for w in q.TOKENS)} AS excluded
FROM (SELECT row_id, unnest({SPLIT}) AS address FROM contacts)""",
    "contacts",
)
def is_excluded_whole_word(t: Tables) -> DataFrame:
    rows = t.contacts.select("row_id", F.explode(text.split_emails(F.col("email"))).alias("address"))
    return rows.withColumn("excluded", exclusion.is_excluded(F.col("address"), q.TOKENS, whole_word=True))


@query(f"WITH {q.EXCLUDED} SELECT row_id, email, given_count, kept_count FROM excluded", "contacts")
def exclude_emails(t: Tables) -> DataFrame:
    return excluded(t).select("row_id", "email", "given_count", "kept_count")


def _excluded_by(words: str) -> str:
    return f"""WITH addresses AS (SELECT row_id, unnest({SPLIT}) AS address, generate_subscripts({SPLIT}, 1) AS pos FROM contacts),
words AS (SELECT DISTINCT lower(trim(token)) AS token FROM {words} WHERE trim(token) <> ''),
kept AS (SELECT row_id, list(address ORDER BY pos) AS kept FROM addresses
 WHERE NOT EXISTS (SELECT 1 FROM words WHERE contains(lower(address), token)) GROUP BY row_id)
SELECT c.row_id, array_to_string(kept, ', ') AS email, CAST(len({q.split_emails('c.email')}) AS INTEGER) AS given_count, CAST(coalesce(len(kept), 0) AS INTEGER) AS kept_count
FROM contacts c LEFT JOIN kept k ON c.row_id = k.row_id"""


@query(_excluded_by("word_table"), "contacts word_table")
def exclude_emails_by_table(t: Tables) -> DataFrame:
    """Words in capitals, with blanks around them, blank ones and NULL among them."""
    out = exclusion.exclude_emails_by_table(t.contacts, t.view("word_table"), "row_id")
    return out.select("row_id", "email", "given_count", "kept_count")


@query(_excluded_by("few_words"), "contacts few_words")
def exclude_emails_by_small_table(t: Tables) -> DataFrame:
    out = exclusion.exclude_emails_by_table(t.contacts, t.view("few_words"), "row_id")
    return out.select("row_id", "email", "given_count", "kept_count")


@query(_excluded_by("few_words"), "contacts few_words")
def exclude_emails_by_list(t: Tables) -> DataFrame:
    """The words of a small table given as a list: one meaning in either form."""
    words = [r["token"] for r in t.view("few_words").collect()]
    return exclusion.exclude_emails(t.contacts, words).select("row_id", "email", "given_count", "kept_count")


@query(
    f"""WITH {q.EXCLUDED}
SELECT CAST(sum(given_count - kept_count) AS BIGINT) AS removed, CAST(sum(kept_count) AS BIGINT) AS remaining,
 (SELECT count(DISTINCT e) FROM (SELECT unnest({SPLIT}) AS e FROM excluded)) AS distinct_emails,
 count(DISTINCT kept_count) AS distinct_counts FROM excluded""",
    "contacts",
)
def exclusion_counts(t: Tables) -> DataFrame:
    return exclusion.exclusion_counts(excluded(t))


CONTACT_STATS = f"""SELECT count(*) AS companies,
 (SELECT count(DISTINCT e) FROM (SELECT unnest({q.split_emails('email', True)}) AS e FROM excluded)) AS unique_emails,
 count(phone) AS phones, count(phone) AS mobile_phones, count(DISTINCT website) AS domains,
 count(DISTINCT nullif({q.url_host('website')}, '')) AS distinct_hosts,
 count(facebook) + count(instagram) + count(linkedin) + count(x) AS social_networks FROM excluded"""


@query(f"WITH {q.EXCLUDED} {CONTACT_STATS}", "contacts")
def contact_stats(t: Tables) -> DataFrame:
    return stats.contact_stats(excluded(t))


@query(
    f"""WITH {q.EXCLUDED}, wide AS (SELECT * FROM ({CONTACT_STATS}))
SELECT metric, CAST(value AS BIGINT) AS value FROM (UNPIVOT wide ON COLUMNS(*) INTO NAME metric VALUE value)""",
    "contacts",
)
def stats_long(t: Tables) -> DataFrame:
    return stats.stats_long(stats.contact_stats(excluded(t)))


@query(
    """SELECT count(*) AS companies, count(*) FILTER (WHERE website <> '') AS domains, count(*) FILTER (WHERE email <> '') AS valid_emails,
 count(*) FILTER (WHERE phone <> '') AS phones, count(*) FILTER (WHERE facebook <> '') + count(*) FILTER (WHERE instagram <> '')
 + count(*) FILTER (WHERE linkedin <> '') + count(*) FILTER (WHERE x <> '') AS social_networks FROM contacts""",
    "contacts",
)
def extraction_stats(t: Tables) -> DataFrame:
    return stats.extraction_stats(t.contacts)


@query(
    """SELECT count(*) AS companies, count(*) FILTER (WHERE website IS DISTINCT FROM '') AS domains,
 count(*) FILTER (WHERE email IS DISTINCT FROM '') AS valid_emails, count(*) FILTER (WHERE phone IS DISTINCT FROM '') AS phones,
 4 * count(*) AS social_networks FROM contacts""",
    "contacts",
)
def extraction_stats_nulls_present(t: Tables) -> DataFrame:
    return stats.extraction_stats(t.contacts, nulls_as_present=True)


@query(
    """SELECT *, CAST(row_number() OVER (ORDER BY number_of_companies DESC, sector) AS INTEGER) AS place FROM
(SELECT main_category AS sector, count(*) AS number_of_companies FROM contacts WHERE main_category IS NOT NULL GROUP BY 1)""",
    "contacts",
)
def sector_counts(t: Tables) -> DataFrame:
    return placed(stats.sector_counts(t.contacts))


@query(
    """SELECT country AS sector, count(*) AS number_of_companies FROM contacts WHERE country IS NOT NULL GROUP BY 1
ORDER BY number_of_companies DESC, sector LIMIT 10""",
    "contacts",
)
def top_sectors(t: Tables) -> DataFrame:
    return stats.top_sectors(stats.sector_counts(t.contacts, "country"), 10)


@query(
    f"""WITH {q.EXCLUDED}
SELECT 'Total rows' AS metric, count(*) AS value FROM excluded
UNION ALL SELECT 'Valid emails', CAST(sum(kept_count) AS BIGINT) FROM excluded
UNION ALL SELECT 'Excluded emails', CAST(sum(given_count - kept_count) AS BIGINT) FROM excluded""",
    "contacts",
)
def basic_stats(t: Tables) -> DataFrame:
    return stats.basic_stats(excluded(t))


@query("SELECT country AS source_file, count(*) AS rows FROM contacts GROUP BY 1", "contacts")
def rows_per_file(t: Tables) -> DataFrame:
    return stats.rows_per_file(t.contacts.withColumnRenamed("country", "source_file"))


def placed(df: DataFrame) -> DataFrame:
    """Rows with the place at which they come, counted from 1."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@query(
    """SELECT row_id, name, reviews, try_cast(reviews AS DOUBLE) AS reviews_number,
 CAST(row_number() OVER (ORDER BY try_cast(reviews AS DOUBLE) DESC NULLS LAST, row_id) AS INTEGER) AS place FROM contacts""",
    "contacts",
)
def sort_by_reviews(t: Tables) -> DataFrame:
    rows = t.contacts.select("row_id", "name", "reviews", text.to_numeric(F.col("reviews")).alias("reviews_number"))
    ordered = with_place(rows, [stats.review_order(), F.col("row_id")])
    return ordered.withColumn("place", F.col("place").cast("int"))


@query(
    "SELECT row_id, name, reviews FROM contacts ORDER BY try_cast(reviews AS DOUBLE) DESC NULLS LAST, row_id LIMIT 20",
    "contacts",
)
def top_rows(t: Tables) -> DataFrame:
    return stats.top_rows(t.contacts, ["row_id"]).select("row_id", "name", "reviews")


@query("SELECT row_id, try_cast(reviews AS DOUBLE) AS reviews FROM contacts", "contacts")
def to_numeric(t: Tables) -> DataFrame:
    return t.contacts.select("row_id", text.to_numeric(F.col("reviews")).alias("reviews"))


def _preview_cell(c: str) -> str:
    v = f"coalesce(CAST({c} AS VARCHAR), 'nan')"
    return f"CASE WHEN length({v}) > 40 THEN left({v}, 40) || '…' ELSE {v} END AS {c}"


@query(
    "SELECT " + ", ".join(_preview_cell(c) for c in ["email", "website", "name", "address", "row_id"])
    + " FROM (SELECT * FROM contacts ORDER BY row_id LIMIT 20)",
    "contacts",
)
def preview(t: Tables) -> DataFrame:
    return schema.preview(t.contacts, ROW, ["email", "website", "name", "address", "row_id", "phone"])


@query(
    "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS text FROM documents",
)
def truncate_text(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", text.truncate_text(F.col("text"), 40).alias("text"))


@query("SELECT row_id, name, email FROM contacts ORDER BY row_id LIMIT 20", "contacts")
def sample_head(t: Tables) -> DataFrame:
    return schema.sample_head(t.contacts, ROW).select("row_id", "name", "email")


# -- web addresses ----------------------------------------------------------


@query(f"SELECT row_id, {q.normalize_url('website')} AS website FROM contacts", "contacts")
def normalize_url(t: Tables) -> DataFrame:
    return t.contacts.select("row_id", text.normalize_url(F.col("website")).alias("website"))


@query(
    r"""SELECT row_id, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END AS website
FROM (SELECT row_id, lower(regexp_extract(s, '^(?:[a-zA-Z]+://)?[^/?#]*')) || substr(s, length(regexp_extract(s, '^(?:[a-zA-Z]+://)?[^/?#]*')) + 1) AS u
 FROM (SELECT row_id, replace(trim(website), ' ', '') AS s FROM contacts))""",
    "contacts",
)
def normalize_url_host_only(t: Tables) -> DataFrame:
    return t.contacts.select(
        "row_id", text.normalize_url(F.col("website"), host_only_lower=True).alias("website")
    )


@query(
    f"SELECT row_id, {q.normalize_url('website')} AS website FROM contacts WHERE website IS NOT NULL AND website <> ''", "contacts"
)
def has_website(t: Tables) -> DataFrame:
    urls = t.contacts.select("row_id", text.normalize_url(F.col("website")).alias("website"))
    return contact_ops.has_website(urls)


@query("SELECT row_id, coalesce(regexp_matches(lower(trim(website)), '^https?://'), FALSE) AS usable FROM sites", "sites")
def is_http_url(t: Tables) -> DataFrame:
    return t.view("sites").select("row_id", text.is_http_url(F.col("website")).alias("usable"))


@query(f"SELECT page_id, {q.url_host('url')} AS host FROM pages")
def url_host(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", text.url_host(F.col("url")).alias("host"))


@query(
    f"""WITH urls AS (SELECT row_id, name, country AS source_file, {q.normalize_url('website')} AS website FROM contacts WHERE website IS NOT NULL)
SELECT * FROM urls QUALIFY row_number() OVER (PARTITION BY source_file, website ORDER BY row_id) = 1""",
    "contacts",
)
def dedupe_keep_first(t: Tables) -> DataFrame:
    rows = t.contacts.select(
        "row_id", "name", F.col("country").alias("source_file"), text.normalize_url(F.col("website")).alias("website")
    ).where("website IS NOT NULL")
    return dedupe.keep_first(rows, ["source_file", "website"], F.col("row_id"))


# -- columns ----------------------------------------------------------------


def _raw(t: Tables) -> DataFrame:
    """Contacts under the headers of an input file."""
    return t.contacts.select(
        "row_id",
        F.col("name").alias(" Nombre"),
        F.col("website").alias("Sitio Web"),
        F.col("email").alias("Correo"),
        F.col("facebook").alias("E-Mail "),
        F.col("phone").alias("Teléfono"),
        F.col("address").alias("Dirección"),
        F.col("main_category").alias("Categoría"),
        F.col("reviews").alias("link"),
        F.col("country").alias("query"),
    )


@query(
    """SELECT row_id, name AS nombre, website AS "sitio web", email AS correo, facebook AS "e-mail", phone AS "teléfono",
 address AS "dirección", main_category AS "categoría", reviews AS link, country AS query FROM contacts""",
    "contacts",
)
def normalize_headers(t: Tables) -> DataFrame:
    return schema.normalize_headers(_raw(t))


@query(
    """SELECT row_id, name, website, coalesce(email, facebook) AS email, phone, address, main_category AS sector, reviews AS link, country AS query
FROM contacts""",
    "contacts",
)
def canonicalize_columns(t: Tables) -> DataFrame:
    return schema.canonicalize_columns(schema.normalize_headers(_raw(t)))


@query("SELECT row_id, name, CAST(NULL AS VARCHAR) AS closed_on, 'Sample' AS main_category FROM contacts", "contacts")
def ensure_column(t: Tables) -> DataFrame:
    rows = schema.ensure_column(t.contacts.select("row_id", "name"), "closed_on")
    return schema.ensure_column(schema.ensure_column(rows, "main_category", "Sample"), "name", "unused")


def _canonical(t: Tables) -> DataFrame:
    return schema.canonicalize_columns(schema.normalize_headers(_raw(t)))


CANON = "SELECT row_id, name, website, coalesce(email, facebook) AS email, phone, address, main_category AS sector"


@query(f"{CANON}, reviews AS link FROM contacts", "contacts")
def drop_columns(t: Tables) -> DataFrame:
    return schema.drop_columns(_canonical(t))[0]


@query(f"{CANON}, reviews AS google_link, country AS query FROM contacts", "contacts")
def rename_columns(t: Tables) -> DataFrame:
    return schema.rename_columns(_canonical(t))[0]


@query(f"{CANON}, reviews AS link, country AS query FROM contacts", "contacts")
def reorder_columns(t: Tables) -> DataFrame:
    return schema.reorder_columns(_canonical(t))[0]


@query(f"{CANON}, reviews AS google_link FROM contacts", "contacts")
def clean_frame(t: Tables) -> DataFrame:
    return schema.clean_frame(_canonical(t))[0]


@query(
    """SELECT row_id, main_category AS sector, name AS company, website AS site FROM contacts""",
    "contacts",
)
def configured_columns(t: Tables) -> DataFrame:
    """Cleaning with lists as they stand in configuration files."""
    return schema.clean_frame(
        t.contacts.select("name", "main_category", "website", "email", "row_id"),
        drop=config_lines("email\n\n phone \n"),
        rename=parse_rename_map("name:company\nno pair\nmain_category : sector\nwebsite:site\n"),
        order=config_lines("row_id\nsector\n"),
    )[0]


@query("SELECT country AS sector, count(*) AS number_of_companies FROM contacts GROUP BY 1", "contacts")
def pick_sector_columns(t: Tables) -> DataFrame:
    counts = t.contacts.groupBy(F.col("country").alias("Main Sector")).agg(
        F.count("*").alias("company_count"), F.max("row_id").alias("last")
    )
    return schema.pick_sector_columns(counts, ("sector", "number_of_companies"))


@query(
    """WITH s AS (SELECT *, coalesce(regexp_matches(lower(trim(website)), '^https?://'), FALSE) AS ok FROM sites)
SELECT row_id, website, CASE WHEN ok THEN email END AS email, CAST(NULL AS VARCHAR) AS facebook, CAST(NULL AS VARCHAR) AS instagram,
 CAST(NULL AS VARCHAR) AS linkedin, CAST(NULL AS VARCHAR) AS x FROM s""",
    "sites",
)
def default_contacts(t: Tables) -> DataFrame:
    out = contact_ops.default_contacts(t.view("sites"))
    return out.select("row_id", "website", "email", "facebook", "instagram", "linkedin", "x")


# -- masks ------------------------------------------------------------------


@query(f"SELECT row_id, {q.mask_email('email')} AS email FROM contacts", "contacts")
def mask_email(t: Tables) -> DataFrame:
    return t.contacts.select("row_id", masks.mask_email(F.col("email")).alias("email"))


@query(f"SELECT row_id, {q.mask_address('email')} AS email FROM contacts", "contacts")
def mask_email_legacy(t: Tables) -> DataFrame:
    return t.contacts.select("row_id", masks.mask_email(F.col("email"), legacy=True).alias("email"))


@query(f"SELECT row_id, {q.mask_phone('phone')} AS phone FROM contacts", "contacts")
def mask_phone(t: Tables) -> DataFrame:
    return t.contacts.select("row_id", masks.mask_phone(F.col("phone")).alias("phone"))


@query(
    f"SELECT row_id, {q.mask_social('facebook')} AS facebook, {q.mask_social('instagram')} AS instagram, {q.mask_social('linkedin')} AS linkedin, {q.mask_social('x')} AS x FROM contacts",
    "contacts",
)
def mask_social(t: Tables) -> DataFrame:
    return t.contacts.select(
        "row_id", *[masks.mask_social(F.col(c)).alias(c) for c in ("facebook", "instagram", "linkedin", "x")]
    )


@query(f"SELECT doc_id, {q.mask_vowels('text')} AS text FROM documents")
def mask_vowels(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", masks.mask_vowels(F.col("text")).alias("text"))


MASKED = f"""SELECT row_id, name, main_category, country, website, {q.mask_email('email')} AS email, {q.mask_phone('phone')} AS phone,
 {q.mask_social('facebook')} AS facebook, {q.mask_social('instagram')} AS instagram, {q.mask_social('linkedin')} AS linkedin,
 {q.mask_social('x')} AS x, {q.mask_vowels('address')} AS address, reviews FROM contacts"""


@query(MASKED, "contacts")
def mask_table(t: Tables) -> DataFrame:
    return masking.mask_table(t.contacts)


@query(
    f"""SELECT row_id, {q.mask_phone('name')} AS hotel, {q.mask_social('website')} AS tax, {q.mask_address('email')} AS email FROM contacts""",
    "contacts",
)
def mask_table_legacy(t: Tables) -> DataFrame:
    rows = t.contacts.select("row_id", F.col("name").alias("hotel"), F.col("website").alias("tax"), "email")
    return masking.mask_table(rows, legacy_names=True, legacy_email=True)


def swept(cell: str, is_email: bool = False, is_phone: bool = False) -> str:
    branches = ""
    if not is_email:
        branches += f" WHEN contains({cell}, '@') AND contains({cell}, '.') THEN {q.mask_email(cell)}"
    if not is_phone:
        branches += (
            f" WHEN length({cell}) >= 7 AND length(regexp_replace({cell}, '[^0-9]', '', 'g')) >= 6 THEN {q.mask_phone(cell)}"
        )
    return f"CASE{branches} ELSE {cell} END"


def guarded_social(c: str) -> str:
    return f"CASE WHEN contains({c}, '/') THEN {q.mask_social(c)} ELSE {c} END"


SWEPT_SOURCE = f"""by_role AS (SELECT row_id, name, main_category, country, website,
 CASE WHEN contains(email, '@') THEN {q.mask_email('email')} ELSE email END AS email,
 CASE WHEN regexp_matches(phone, '[0-9]') THEN {q.mask_phone('phone')} ELSE phone END AS phone,
 {guarded_social('facebook')} AS facebook, {guarded_social('instagram')} AS instagram, {guarded_social('linkedin')} AS linkedin,
 {guarded_social('x')} AS x, {q.mask_vowels('address')} AS address, reviews FROM {{source}})"""

SWEPT_COLUMNS = "row_id, " + ", ".join(
    f"{swept(c, c == 'email', c == 'phone')} AS {c}"
    for c in ["name", "main_category", "country", "website", "email", "phone", "facebook", "instagram", "linkedin", "x", "address", "reviews"]
)


@query(f"WITH {SWEPT_SOURCE.replace('{source}', 'contacts')} SELECT {SWEPT_COLUMNS} FROM by_role", "contacts")
def mask_sweep(t: Tables) -> DataFrame:
    return masking.mask_sweep(t.contacts)


@query(f"WITH {SWEPT_SOURCE.replace('{source}', 'contacts')} SELECT {SWEPT_COLUMNS} FROM by_role", "contacts")
def mask_report(t: Tables) -> DataFrame:
    report = {"data": t.contacts, "sectors": stats.sector_counts(t.contacts)}
    return masking.mask_report(report)["data"]


# -- verification -----------------------------------------------------------


@query(f"SELECT row_id, address, string_split(address, '@')[2] AS domain FROM (SELECT row_id, unnest({SPLIT}) AS address FROM contacts)", "contacts")
def email_domain(t: Tables) -> DataFrame:
    rows = t.contacts.select("row_id", F.explode(text.split_emails(F.col("email"))).alias("address"))
    return rows.withColumn("domain", text.email_domain(F.col("address")))


@query(
    r"""SELECT row_id, coalesce(regexp_matches(email, '^[^@]+@[^@]+\.[^@]+'), FALSE) AS email_ok,
 regexp_matches(name, '^[^@]+@[^@]+\.[^@]+') AS name_ok FROM contacts""",
    "contacts",
)
def email_format_valid(t: Tables) -> DataFrame:
    return t.contacts.select(
        "row_id",
        verification.email_format_valid(F.col("email")).alias("email_ok"),
        verification.email_format_valid(F.col("name")).alias("name_ok"),
    )


def _verification_sql(mode: str) -> str:
    probe = "FALSE" if mode == "basic" else "TRUE"
    return f"""SELECT row_id, email, well AS format_valid, well AND {probe} AND coalesce(domain_exists, FALSE) AS domain_exists,
 well AND {probe} AND coalesce(domain_exists, FALSE) AND coalesce(mx_exists, FALSE) AS mx_exists,
 well AND {'TRUE' if mode == 'ultra' else 'FALSE'} AND coalesce(domain_exists, FALSE) AND coalesce(mx_exists, FALSE) AS smtp_verified,
 '{mode}' AS mode, {q.STATUS.replace('{mode}', mode)} AS status
FROM (SELECT *, regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+') AS well FROM (SELECT row_id, unnest({SPLIT}) AS email FROM contacts))
LEFT JOIN domains ON domain = string_split(email, '@')[2]"""


def _verified(t: Tables, mode: str) -> DataFrame:
    rows = t.contacts.select("row_id", F.explode(text.split_emails(F.col("email"))).alias("email"))
    return verify_emails(rows, t.view("domains"), mode)


@query(_verification_sql("basic"), "contacts domains")
def verify_emails_basic(t: Tables) -> DataFrame:
    return _verified(t, "basic")


@query(_verification_sql("advanced"), "contacts domains", name="verify_emails")
def verify_emails_advanced(t: Tables) -> DataFrame:
    return _verified(t, "advanced")


@query(_verification_sql("ultra"), "contacts domains")
def verify_emails_ultra(t: Tables) -> DataFrame:
    return _verified(t, "ultra")


@query(
    f"""WITH checked AS ({_verification_sql('advanced')})
SELECT status, count(*) AS emails FROM checked GROUP BY 1""",
    "contacts domains",
)
def verification_status(t: Tables) -> DataFrame:
    return _verified(t, "advanced").groupBy("status").agg(F.count("*").alias("emails"))


@query(
    f"""SELECT country, count(*) AS companies, CAST(sum(len({SPLIT})) AS BIGINT) AS emails, count(phone) AS phones, any_value(image) AS image
FROM contacts LEFT JOIN (SELECT n_name, n_name || '.jpg' AS image FROM nation WHERE n_nationkey % 2 = 1) ON n_name = country GROUP BY country""",
    "contacts",
)
def country_rollup(t: Tables) -> DataFrame:
    images = t.table("nation").where("n_nationkey % 2 = 1").select(
        F.col("n_name").alias("base_name"), F.concat("n_name", F.lit(".jpg")).alias("image")
    )
    return stats.country_rollup(stats.stats_by(t.contacts, "country"), images)
