"""Pieces of SQL shared by the checks."""

from __future__ import annotations

# Own short list of unwanted words; real lists are user data.
TOKENS = ["legal", "noreply", "ana"]


def split_emails(cell: str, comma_only: bool = False) -> str:
    text = f"coalesce({cell}, '')" if comma_only else f"replace(coalesce({cell}, ''), ';', ',')"
    return (
        f"list_filter(list_transform(string_split({text}, ','), lambda e: trim(e)), lambda e: e <> '')"
    )


def unwanted(address: str) -> str:
    return "(" + " OR ".join(f"contains(lower({address}), '{t}')" for t in TOKENS) + ")"


def join_list(values: str) -> str:
    return f"CASE WHEN len({values}) > 0 THEN array_to_string({values}, ', ') END"


def mask_address(e: str) -> str:
    return (
        f"CASE WHEN instr({e}, '@') > 1 THEN left({e}, 1) || repeat('*', instr({e}, '@') - 2)"
        f" || substr({e}, instr({e}, '@')) ELSE {e} END"
    )


def mask_email(cell: str) -> str:
    return (
        f"CASE WHEN contains({cell}, '@') THEN array_to_string(list_transform({split_emails(cell)},"
        f" lambda e: {mask_address('e')}), ', ') ELSE {cell} END"
    )


def mask_phone(p: str) -> str:
    return f"CASE WHEN length({p}) > 2 THEN left({p}, length({p}) - 2) || '**' WHEN {p} IS NOT NULL THEN '**' END"


def mask_social(u: str) -> str:
    return f"left(split_part({u}, '/', -1), 2) || '****'"


def mask_vowels(t: str) -> str:
    return f"regexp_replace({t}, '[aeiouAEIOU]', '*', 'g')"


def normalize_url(u: str) -> str:
    s = f"replace(lower(trim({u})), ' ', '')"
    return f"CASE WHEN {s} = '' OR regexp_matches({s}, '^https?://') THEN {s} ELSE 'https://' || {s} END"


def url_host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


EXCLUDED = f"""excluded AS (
SELECT * EXCLUDE (email, given, kept), CAST(len(given) AS INTEGER) AS given_count, CAST(len(kept) AS INTEGER) AS kept_count, {join_list('kept')} AS email
FROM (SELECT *, list_filter(given, lambda e: NOT {unwanted('e')}) AS kept
 FROM (SELECT *, {split_emails('email')} AS given FROM contacts)))"""

EMAILS_IN = r"list_sort(list_distinct(regexp_extract_all({0}, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+')))"


def extract_emails(text: str) -> str:
    return EMAILS_IN.replace("{0}", text)


def extract_links(html: str) -> str:
    pattern = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
    raw = f"regexp_extract_all({html}, '{pattern}', 1)"
    bare = f"list_transform({raw}, lambda h: replace(trim(trim(h, '\"''')), '&amp;', '&'))"
    return f"list_filter({bare}, lambda h: h <> '')"


def resolve(link: str, url: str) -> str:
    origin = f"regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*')"
    bare = f"regexp_replace({url}, '[?#].*$', '')"
    folder = f"(CASE WHEN {bare} = {origin} THEN {bare} || '/' ELSE regexp_replace({bare}, '[^/]*$', '') END)"
    return (
        f"CASE WHEN regexp_matches({link}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {link}"
        f" WHEN starts_with({link}, '//') THEN regexp_extract({url}, '^([a-zA-Z]+:)//', 1) || {link}"
        f" WHEN starts_with({link}, '/') THEN {origin} || {link}"
        f" WHEN starts_with({link}, '#') THEN regexp_replace({url}, '#.*$', '') || {link}"
        f" WHEN starts_with({link}, '?') THEN {bare} || {link}"
        f" ELSE {folder} || {link} END"
    )


def is_network(u: str, network: str) -> str:
    return {
        "facebook": f"(contains({u}, 'facebook.com/') AND NOT contains({u}, 'sharer') AND NOT contains({u}, 'share') AND length({u}) < 100)",
        "instagram": f"(contains({u}, 'instagram.com/') AND NOT contains({u}, 'share') AND NOT contains({u}, 'stories') AND length({u}) < 100)",
        "linkedin": f"(contains({u}, 'linkedin.com/') AND (contains({u}, '/in/') OR contains({u}, '/company/')) AND NOT contains({u}, 'share') AND NOT contains({u}, 'sharing') AND length({u}) < 100)",
        "x": f"((contains({u}, 'x.com/') OR contains({u}, 'twitter.com/')) AND NOT contains({u}, 'share') AND NOT contains({u}, 'intent') AND length({u}) < 100)",
    }[network]


NETWORKS = ["facebook", "instagram", "linkedin", "x"]


def social_class(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {is_network(u, n)} THEN '{n}'" for n in NETWORKS) + " END"


def classified(links: str, network: str) -> str:
    return f"list_sort(list_distinct(list_filter({links}, lambda u: coalesce({social_class('u')} = '{network}', FALSE))))"


# Contacts per page of the linked pages, as lists.
PAGE_CONTACTS = f"""page_links AS (
SELECT page_id, url AS website, {extract_emails('html')} AS email, {extract_links('html')} AS raw_links FROM linked_pages),
resolved_links AS (
SELECT page_id, website, email, list_transform(raw_links, lambda h: {resolve('h', 'website')}) AS links FROM page_links),
page_contacts AS (
SELECT website, email, {', '.join(classified('links', n) + ' AS ' + n for n in NETWORKS)} FROM resolved_links)"""

# The same after verification of the addresses.
STATUS = """CASE WHEN NOT regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+') THEN 'invalid'
 WHEN '{mode}' = 'basic' THEN 'valid'
 WHEN NOT coalesce(domain_exists, FALSE) THEN 'invalid'
 WHEN NOT coalesce(mx_exists, FALSE) THEN 'doubtful' ELSE 'valid' END"""

VALID_CONTACTS = PAGE_CONTACTS + f""",
addresses AS (SELECT website, unnest(email) AS email FROM page_contacts),
checked AS (SELECT website, email, {STATUS.replace('{mode}', 'advanced')} AS status
 FROM addresses LEFT JOIN domains ON domain = string_split(email, '@')[2]),
valid_emails AS (SELECT website, list_sort(list(email)) AS email FROM checked WHERE status = 'valid' GROUP BY website),
valid_contacts AS (SELECT p.* EXCLUDE (email), v.email FROM page_contacts p LEFT JOIN valid_emails v USING (website))"""


def time_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"
