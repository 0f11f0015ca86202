"""String, URL and address-list expressions. Everything stays on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes; trim() alone only removes spaces.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: what counts as an e-mail address inside page text.
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
# Every character an address can contain but its '@'.
_ADDRESS_RUN = r"^[a-zA-Z0-9_.+-]*"
_RUN_WINDOW = 256

_ANCHOR_HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """NULL is the only empty value inside the engine."""
    return F.when(strip(text) != "", text)


def is_filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def normalize_url(url: Column, host_only_lower: bool = False) -> Column:
    """Trim, lower-case, drop spaces and add ``https://`` where no scheme is given."""
    spaceless = F.replace(strip(url), F.lit(" "))
    if host_only_lower:
        head = F.regexp_extract(spaceless, r"^(?:[a-zA-Z]+://)?[^/?#]*", 0)
        cleaned = F.concat(F.lower(head), F.substr(spaceless, F.length(head) + 1))
    else:
        cleaned = F.lower(spaceless)
    has_scheme = cleaned.startswith("http://") | cleaned.startswith("https://")
    return F.when(has_scheme | (cleaned == ""), cleaned).otherwise(
        F.concat(F.lit("https://"), cleaned)
    )


def is_http_url(url: Column) -> Column:
    low = F.lower(strip(url))
    return F.coalesce(low.startswith("http://") | low.startswith("https://"), F.lit(False))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _around_at_signs(text: Column) -> Column:
    """The text without what cannot belong to an address.

    Between two '@' only the run after the first and the run before the second
    can. Cutting at '@' and matching at the ends of the parts is many times
    faster than trying the address pattern at every character of a page.
    """

    def last_run(part: Column) -> Column:
        return F.reverse(F.regexp_extract(F.reverse(part), _ADDRESS_RUN, 0))

    def ends(part: Column) -> Column:
        head = F.regexp_extract(part, _ADDRESS_RUN, 0)
        # Only a run that fills the window needs the whole part turned round.
        window = last_run(F.right(part, F.lit(_RUN_WINDOW)))
        tail = F.when(F.length(window) < _RUN_WINDOW, window).otherwise(last_run(part))
        return F.when(F.length(head) == F.length(part), part).otherwise(F.concat(head, F.lit(" "), tail))

    return F.array_join(F.transform(F.split(text, "@"), ends), "@")


def extract_emails(html: Column, trim_dot: bool = False) -> Column:
    """Distinct addresses found in a text, sorted."""
    found = F.regexp_extract_all(_around_at_signs(html), F.lit(EMAIL_PATTERN), F.lit(0))
    if trim_dot:
        found = F.transform(found, lambda e: F.regexp_replace(e, r"\.+$", ""))
    # A plain search for '@' passes over texts that cannot match.
    return F.when(F.contains(html, F.lit("@")), F.array_sort(F.array_distinct(found))).otherwise(
        F.array().cast("array<string>")
    )


def extract_links(html: Column) -> Column:
    """``href`` of every ``<a>`` in document order, without empty ones."""
    raw = F.regexp_extract_all(html, F.lit(_ANCHOR_HREF), F.lit(1))
    bare = F.transform(raw, lambda h: F.replace(_unquote(h), F.lit("&amp;"), F.lit("&")))
    return F.filter(F.coalesce(bare, F.array().cast("array<string>")), lambda h: h != "")


def _unquote(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return strip(F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def resolve_links(links: Column, page_url: Column) -> Column:
    """Make links absolute the way a browser reports them."""
    bare = F.regexp_replace(page_url, r"[?#].*$", "")
    page = F.struct(
        F.regexp_extract(page_url, r"^([a-zA-Z]+:)//", 1).alias("scheme"),
        F.regexp_extract(page_url, r"^[a-zA-Z]+://[^/?#]*", 0).alias("origin"),
        bare.alias("bare"),
        F.regexp_replace(bare, r"[^/]*$", "").alias("folder"),
        F.regexp_replace(page_url, r"#.*$", "").alias("document"),
    )

    def resolve(link: Column, base: Column) -> Column:
        root = base["bare"] == base["origin"]
        return (
            F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(base["scheme"], link))
            .when(link.startswith("/"), F.concat(base["origin"], link))
            .when(link.startswith("#"), F.concat(base["document"], link))
            .when(link.startswith("?"), F.concat(base["bare"], link))
            .when(root, F.concat(base["bare"], F.lit("/"), link))
            .otherwise(F.concat(base["folder"], link))
        )

    return let(page, lambda base: F.transform(links, lambda link: resolve(link, base)))


def distinct_values(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def join_list(values: Column, sep: str = ", ") -> Column:
    """Array to one cell; an empty array becomes NULL."""
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def split_emails(cell: Column, separators: str = ",;") -> Column:
    """Addresses of a cell: separators unified, each part trimmed, blanks dropped."""
    pattern = f"[{WHITESPACE}]*[{separators}][{WHITESPACE}]*"
    parts = F.split(strip(F.coalesce(cell, F.lit(""))), pattern)
    return F.array_remove(parts, "")


def rejoin_emails(emails: Column) -> Column:
    return join_list(emails)


def email_domain(email: Column) -> Column:
    return F.get(F.split(email, "@"), F.lit(1))


def truncate_text(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """Lower-case suffix with its dot; '' where there is none (also for dot files)."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def content_md5(content: Column) -> Column:
    return F.md5(content)


def to_numeric(text: Column) -> Column:
    """Number of a text cell; NULL where it is none."""
    return strip(text).try_cast("double")
