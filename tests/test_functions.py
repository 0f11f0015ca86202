"""Row tables for the scalar functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from listwright.functions import errors, masks, patterns, social, text, timing, verification

WS = text.WHITESPACE


def apply(spark, values, fn):
    """Result of an expression for each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_whitespace_is_what_python_strips():
    assert set(WS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_normalize_url(spark):
    given = [" WWW.Shop1.net/Home Page ", "HTTP://A.com", "", "  ", "ftp://a.com", None, "\ta.com\n"]
    assert apply(spark, given, text.normalize_url) == [
        "https://www.shop1.net/homepage", "http://a.com", "", "", "https://ftp://a.com", None, "https://a.com",
    ]
    host_only = lambda c: text.normalize_url(c, host_only_lower=True)
    assert apply(spark, ["HTTP://A.com/Path?Q", "A.com/X"], host_only) == ["http://a.com/Path?Q", "https://a.com/X"]


def test_split_emails(spark):
    given = ["a@x.net; B@x.net, ,", None, "", " ; ,", "\ta@x.net\n,b@x.net", "a@x.net"]
    assert apply(spark, given, text.split_emails) == [
        ["a@x.net", "B@x.net"], [], [], [], ["a@x.net", "b@x.net"], ["a@x.net"],
    ]


def test_mask_email(spark):
    given = ["info@shop.net", "a@x.com", "@x.com", "no-at", None, "ann@x.com, bob@y.com", "a@b@c"]
    assert apply(spark, given, masks.mask_email) == [
        "i***@shop.net", "a@x.com", "@x.com", "no-at", None, "a**@x.com, b**@y.com", "a@b@c",
    ]
    assert apply(spark, ["ann@x.com, bob@y.com"], lambda c: masks.mask_email(c, legacy=True)) == ["a**@x.com, bob@y.com"]
    assert apply(spark, ["a@x.com", "ab@x.com", "abc@x.com"], lambda c: masks.mask_email(c, min_masked=2)) == [
        "*@x.com", "**@x.com", "a**@x.com",
    ]


def test_mask_phone(spark):
    assert apply(spark, ["+34 600 000001", "12", "7", "", None], masks.mask_phone) == [
        "+34 600 0000**", "**", "**", "**", None,
    ]


def test_mask_social(spark):
    given = ["https://x.com/handle", "https://instagram.com/s5/", "ab", None]
    assert apply(spark, given, masks.mask_social) == ["ha****", "****", "ab****", None]


def test_mask_vowels(spark):
    assert apply(spark, ["Calle Ñú", None], masks.mask_vowels) == ["C*ll* Ñú", None]


def test_masking_hides_the_local_part(spark):
    given = [f"{'abcdefgh'[:n]}@x.com" for n in range(2, 9)]
    for before, after in zip(given, apply(spark, given, masks.mask_email)):
        assert before.split("@")[0] not in after and len(before) == len(after)


def test_truncate_text(spark):
    cut = lambda c: text.truncate_text(c, 3)
    assert apply(spark, ["abc", "abcd", "ñandú", None], cut) == ["abc", "abc…", "ñan…", None]


def test_file_extension(spark):
    given = ["a/b.CSV", "b", ".bashrc", "a.b/c", "x.tar.gz", "a/.hidden"]
    assert apply(spark, given, text.file_extension) == [".csv", "", "", "", ".gz", ""]


def test_email_format(spark):
    given = ["a@b.c", "a@b", "@b.c", "a@@b.c", "a b@c.d.e", "x@y.z@w", None]
    want = [bool(re.match(r"[^@]+@[^@]+\.[^@]+", g)) if g else False for g in given]
    assert apply(spark, given, verification.email_format_valid) == want


@pytest.mark.parametrize(
    "email,exists,mx,want",
    [
        ("bad", True, True, {"basic": "invalid", "advanced": "invalid", "ultra": "invalid"}),
        ("a@b.c", False, True, {"basic": "valid", "advanced": "invalid", "ultra": "invalid"}),
        ("a@b.c", None, None, {"basic": "valid", "advanced": "invalid", "ultra": "invalid"}),
        ("a@b.c", True, False, {"basic": "valid", "advanced": "doubtful", "ultra": "doubtful"}),
        ("a@b.c", True, True, {"basic": "valid", "advanced": "valid", "ultra": "valid"}),
    ],
)
def test_verification_status(spark, email, exists, mx, want):
    df = spark.createDataFrame([(email, exists, mx)], "e string, d boolean, m boolean")
    for mode, status in want.items():
        record = verification.verification_record(F.col("e"), F.col("d"), F.col("m"), mode)
        assert df.select(record.alias("r")).select(verification.verification_status(F.col("r"), mode)).first()[0] == status


def random_texts(count, seed, alphabet="ab1@@..-_+ <é"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def test_extract_emails_matches_a_plain_scan(spark):
    given = random_texts(3000, 7) + ["x" * 600 + "@a.b", "é" + "y" * 300 + "@a.b @ q@w.e", "a@b.c@d.e", "a@b.c_d@e.f"]
    pattern = re.compile(text.EMAIL_PATTERN)
    want = [sorted(set(pattern.findall(g)), key=lambda s: s.encode()) for g in given]
    assert apply(spark, given, text.extract_emails) == want


def test_extract_links(spark):
    html = (
        """<a href="/x">1</a><A class=z HREF='https://b.c/?a=1&amp;b=2'>2</A><a data-href="no" href=plain>3</a>"""
        """<abbr href="no"><a name="n"></a><a href="">4</a><a\nhref = " sp ">5</a><a href="it's">6</a>"""
    )
    assert apply(spark, [html, "none", None], text.extract_links) == [
        ["/x", "https://b.c/?a=1&b=2", "plain", "sp", "it's"], [], [],
    ]


def test_resolve_links(spark):
    links = ["https://a.b/c", "//c.d/e", "/root", "leaf", "?q=1", "#top", "mailto:a@b.c"]
    for page, want in {
        "https://s.t/dir/page?x=1#f": [
            "https://a.b/c", "https://c.d/e", "https://s.t/root", "https://s.t/dir/leaf",
            "https://s.t/dir/page?q=1", "https://s.t/dir/page?x=1#top", "mailto:a@b.c",
        ],
        "http://s.t": [
            "https://a.b/c", "http://c.d/e", "http://s.t/root", "http://s.t/leaf", "http://s.t?q=1",
            "http://s.t#top", "mailto:a@b.c",
        ],
    }.items():
        df = spark.createDataFrame([(page, links)], "p string, l array<string>")
        assert df.select(text.resolve_links(F.col("l"), F.col("p"))).first()[0] == want


def plain_class(u):
    """The cascade, written out."""
    short = len(u) < 100
    if "facebook.com/" in u and "share" not in u and short:
        return "facebook"
    if "instagram.com/" in u and "share" not in u and "stories" not in u and short:
        return "instagram"
    if "linkedin.com/" in u and ("/in/" in u or "/company/" in u) and "shar" not in u.replace("shark", "") and short:
        return "linkedin"
    if ("x.com/" in u or "twitter.com/" in u) and "share" not in u and "intent" not in u and short:
        return "x"
    return None


def test_social_class(spark):
    hosts = ["facebook.com/", "instagram.com/", "linkedin.com/", "x.com/", "twitter.com/", "other.org/"]
    paths = ["p", "share", "sharer", "stories/x", "in/a", "company/b", "intent/t", "sharing", "a" * 90]
    given = [f"https://{a}{p}{s}" for a in hosts for p in paths for s in ("", "/in/", "?u=x.com/y")]
    assert apply(spark, given, social.social_class) == [plain_class(u) for u in given]


def test_classify_social_puts_a_link_in_one_class(spark):
    links = ["https://facebook.com/b", "https://facebook.com/a", "https://facebook.com/a", "https://facebook.com/share?x.com/", "n"]
    df = spark.createDataFrame([(links,), ([],)], "l array<string>")
    first, empty = df.select(social.classify_social(F.col("l")).alias("s")).select("s.*").collect()
    assert tuple(first) == (["https://facebook.com/a", "https://facebook.com/b"], [], [], [])
    assert tuple(empty) == ([], [], [], [])


def test_one_decimal_rounds_as_python(spark):
    rng = random.Random(3)
    values = [i / 60 for i in range(0, 4000)] + [i / 4 for i in range(200)] + [i / 20 for i in range(400)]
    values += [rng.uniform(0, 10 ** rng.randint(0, 6)) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(timing.one_decimal(F.col("v"))).collect()]
    assert got == [f"{v:.1f}" for v in values]


def test_format_duration(spark):
    df = spark.createDataFrame([(0.0,), (59.94,), (60.0,), (3599.0,), (3600.0,), (7290.0,)], "v double")
    assert [r[0] for r in df.select(timing.format_duration(F.col("v"))).collect()] == [
        "0.0s", "59.9s", "1.0m", "60.0m", "1.0h", "2.0h",
    ]


def test_expiry_and_liveness(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS c, t FROM VALUES (10), (0), (NULL) AS v(t)")
    spans = df.select(timing.seconds_between(F.col("c"), timing.expiry(F.col("c"), F.col("t")))).collect()
    assert [r[0] for r in spans] == [10.0, 3600.0, 3600.0]
    edge = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS e").select(timing.is_live(F.col("e"), F.col("e")))
    assert edge.first()[0] is False


@pytest.mark.parametrize(
    "kind,message,category,retriable",
    [
        ("TimeoutException", "x", "NETWORK", True),
        ("ConnectionResetError", "x", "NETWORK", True),
        ("ValueError", "net::ERR_TIMED_OUT", "NETWORK", False),
        ("NoSuchElementException", "gone", "DOM", False),
        ("NoSuchElementException", "Connection lost", "DOM", True),
        ("WebDriverException", "Disconnected", "GENERAL", True),
        ("ValueError", "timeout", "GENERAL", False),
        (None, None, "GENERAL", False),
    ],
)
def test_error_classes(spark, kind, message, category, retriable):
    df = spark.createDataFrame([(kind, message)], "t string, m string")
    got = df.select(errors.error_category(F.col("t"), F.col("m")), errors.is_retriable(F.col("t"), F.col("m"))).first()
    assert tuple(got) == (category, retriable)


def test_globs(spark):
    import pathlib

    names = ["a.tmp", "x/b.log.1", "c.log", "__pycache__", "d/__pycache__", "~lock", "e~", "f.cache", "g[1].bak", "dir/sub/h.py"]
    globs = [*patterns.TEMP_PATTERNS, "sub/*.py", "g[[]1].b?k"]
    want = [any(pathlib.PurePosixPath(n).match(g) for g in globs) for n in names]
    assert apply(spark, names, lambda c: patterns.matches_patterns(c, globs)) == want


def test_error_line(spark):
    df = spark.createDataFrame([("GENERAL", "ValueError", "bad", None, None)], "c string, t string, m string, u string, o string")
    line = df.select(errors.error_line(*[F.col(c) for c in "ctmuo"])).first()[0]
    assert line == "[GENERAL] ValueError: bad | URL: N/A | Operation: N/A"
