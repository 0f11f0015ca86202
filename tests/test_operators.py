"""Operators against brute force, with hot keys and under different partitionings."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listwright.functions.patterns import minimal_tokens, trie_regex
from listwright.functions.text import split_emails
from listwright.operators import cache, dedupe, exclusion, files, masking, schema, stats
from listwright.operators.attempts import attempt_state, completed_rows, pending_rows
from listwright.operators.contacts import attach_contacts
from listwright.operators.skew import skew_join
from tests.conftest import rows

WORDS = st.lists(st.text("ab.+c-é", min_size=0, max_size=4), max_size=8)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.text("ab.+c-é@", max_size=12))
def test_trie_finds_what_any_token_finds(tokens, address):
    wanted = {t.strip().lower() for t in tokens} - {""}
    pattern = trie_regex(tokens)
    found = bool(pattern and re.search(pattern, address))
    assert found == any(t in address for t in wanted)


def test_minimal_tokens():
    assert minimal_tokens(["Ana", "mariana", " ", "opt-out", "ana"]) == ["ana", "opt-out"]


def contact_cells(spark, count=400, seed=5):
    rng = random.Random(seed)
    names = ["ana", "Banana", "info", "sentry.io", "sentryxio", "legal", "x"]
    cells = []
    for i in range(count):
        parts = [f"{rng.choice(names)}{rng.choice(['', str(i)])}@{rng.choice(names)}.net" for _ in range(rng.randint(0, 3))]
        cells.append((i, None if not parts else rng.choice([", ", ";"]).join(parts)))
    # One address in a third of the rows.
    cells += [(count + i, "hot@ana.net, cold@b.net") for i in range(count // 2)]
    return spark.createDataFrame(cells, "row_id bigint, email string")


TOKENS = ["ana", "sentry.io", "legal1"]


def brute_exclusion(cells):
    out = []
    for row_id, cell in cells:
        parts = [p.strip() for p in (cell or "").replace(";", ",").split(",") if p.strip()]
        kept = [p for p in parts if not any(t in p.lower() for t in TOKENS)]
        out.append((row_id, ", ".join(kept) or None, len(parts), len(kept)))
    return sorted(out, key=str)


def test_exclusion_forms_agree(spark):
    cells = contact_cells(spark)
    want = brute_exclusion([tuple(r) for r in cells.collect()])
    columns = ["row_id", "email", "given_count", "kept_count"]
    assert rows(exclusion.exclude_emails(cells, TOKENS).select(columns)) == want
    words = spark.createDataFrame([(t,) for t in TOKENS], "token string")
    odd = spark.createDataFrame([(f" {t.upper()} ",) for t in TOKENS] + [(None,), ("  ",), ("",)], "token string")
    for table in (words, odd):
        out = exclusion.exclude_emails_by_table(cells, table, "row_id")
        assert rows(out.select(columns)) == want
    assert rows(exclusion.exclude_emails(cells, [r["token"] for r in odd.collect()]).select(columns)) == want
    nothing = exclusion.exclude_emails_by_table(cells, words.limit(0), "row_id")
    assert nothing.where("given_count <> kept_count").count() == 0
    distinct = cells.select(F.explode(split_emails(F.col("email"))).alias("a")).distinct()
    hits = [r["a"] for r in distinct.collect() if any(t in r["a"].lower() for t in TOKENS)]
    got = exclusion.addresses_with_token(distinct, "a", exclusion.usable_words(words))
    assert sorted(r["a"] for r in got.collect()) == sorted(hits)


def test_exclusion_is_idempotent_and_monotone(spark):
    cells = contact_cells(spark)
    once = exclusion.exclude_emails(cells, TOKENS).select("row_id", "email")
    twice = exclusion.exclude_emails(once, TOKENS)
    assert twice.where("given_count <> kept_count").count() == 0
    more = exclusion.exclude_emails(cells, [*TOKENS, "info"]).agg(F.sum("kept_count")).first()[0]
    assert more <= once.agg(F.sum(F.size(F.split("email", ",")))).first()[0]
    counts = exclusion.exclusion_counts(exclusion.exclude_emails(cells, TOKENS)).first()
    total = cells.agg(F.sum(F.size(F.split(F.regexp_replace("email", ";", ","), ",")))).first()[0]
    assert counts["removed"] + counts["remaining"] == total


def test_no_tokens_exclude_nothing(spark):
    cells = contact_cells(spark, 20)
    assert exclusion.exclude_emails(cells, []).where("given_count <> kept_count").count() == 0


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_skew_join_equals_a_plain_join(spark, how):
    left = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    odd = right.unionAll(spark.createDataFrame([(None, 7)], "k string, v int"))
    plain = left.join(right, "k", how)
    assert rows(skew_join(left, odd, "k", how).select(plain.columns)) == rows(plain)


def test_hot_rows_are_split(spark):
    """Spark itself divides the partition of a key with a third of the rows."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(60000).repartition(8).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
        out = skew_join(left, spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int"), "k")
        assert out.where("v = 1").count() == 20000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_keep_first_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    data = [(i, f"f{i % 3}", rng.choice(["hot"] * 5 + [str(i % 40)])) for i in range(2000)]
    want = {}
    for i, f, w in data:
        want.setdefault((f, w), i)
    for parts in (1, 8):
        df = spark.createDataFrame(data, "i int, f string, w string").repartition(parts)
        got = dedupe.keep_first(df, ["f", "w"], F.col("i"))
        assert rows(got) == sorted(((i, f, w) for (f, w), i in want.items()), key=str)


def file_rows(spark):
    rng = random.Random(2)
    data = [(f"p{i:04d}", rng.choice([0, 5, 7]), rng.choice("abc"), rng.randint(0, 20)) for i in range(300)]
    data += [(f"hot{i:04d}", 9, "h", i % 7) for i in range(150)]
    df = spark.createDataFrame(data, "path string, length bigint, content_md5 string, t bigint")
    return data, df.withColumn("mtime", F.timestamp_seconds(F.col("t") * 86400)).drop("t")


def test_duplicates(spark):
    data, df = file_rows(spark)
    full = df.where("length > 0")
    groups = {}
    for path, length, digest, t in data:
        if length:
            groups.setdefault((length, digest), []).append((-t, path))
    members = sorted(p for g in groups.values() if len(g) > 1 for _, p in g)
    newest = sorted(p for g in groups.values() for _, p in sorted(g)[1:])
    first = sorted(p for g in groups.values() for p in sorted(p for _, p in g)[1:])
    path = lambda d: sorted(r["path"] for r in d.collect())
    assert path(dedupe.duplicate_members(full)) == members
    assert path(dedupe.duplicates_to_drop(full)) == newest
    assert path(dedupe.duplicates_to_drop(full, keep="first")) == first
    assert dedupe.duplicate_groups(full).agg(F.sum("copies")).first()[0] == len(members)


def test_retention_keeps_the_newest(spark):
    data, df = file_rows(spark)
    at = F.timestamp_seconds(F.lit(20 * 86400))
    got = sorted(r["path"] for r in files.retention_candidates(df, at, 7, 5, ["content_md5"]).collect())
    want = []
    for digest in "abch":
        ranked = sorted((-t, p) for p, _, d, t in data if d == digest)
        want += [p for t, p in ranked[5:] if 20 + t >= 7]
    assert got == sorted(want)


def test_cache_lookup_against_brute_force(spark):
    rng = random.Random(4)
    stamp = lambda: rng.randint(0, 40_000)
    key = lambda: rng.choice(["hot", "hot", "a", "b", "c"])
    entries = [(key(), i, c, c + rng.choice([10, 500, 9000])) for i, c in enumerate(stamp() for _ in range(200))]
    asked = [(i, key(), stamp()) for i in range(400)]
    asked += [(1000 + i, k, c) for i, (k, _, c, _) in enumerate(entries[:50])]
    store = spark.createDataFrame(entries, "key string, value int, c long, e long").select(
        "key", "value", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("e").alias("expires_at")
    )
    requests = spark.createDataFrame(asked, "req_id int, key string, t long").select(
        "req_id", "key", F.timestamp_seconds("t").alias("req_ts")
    )
    want = []
    for req, k, t in asked:
        seen = [(c, v, e) for kk, v, c, e in entries if kk == k and c <= t]
        hit = bool(seen) and max(seen)[2] > t
        want.append((req, hit, max(seen)[1] if hit else None))
    for width in (60, 3600, 100_000):
        got = cache.cache_lookup(requests, store, slot_seconds=width).select("req_id", "hit", "value")
        assert rows(got) == sorted(want, key=str)


def test_purge_removes_what_expires_now(spark):
    store = spark.sql("SELECT 'k' AS key, 1 AS value, TIMESTAMP'2024-01-01' AS created_at, TIMESTAMP'2024-01-02' AS expires_at")
    now = F.lit("2024-01-02").cast("timestamp")
    assert cache.expired_entries(store, now).count() == 1 and cache.live_entries(store, now).count() == 0


def brute_attempts(log):
    """The job log replayed one entry at a time."""
    done, failed = set(), {}
    for seq, row, ok in sorted(log):
        if ok:
            if row not in done:
                done.add(row)
                failed.pop(row, None)
        else:
            failed[row] = seq
    return done, failed


def test_attempt_state_equals_a_replay(spark):
    rng = random.Random(6)
    log = [(i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]), rng.random() < 0.4) for i in range(60)]
    df = spark.createDataFrame(log, "seq bigint, row_id bigint, success boolean").selectExpr(
        "'j' AS job_name", "*", "timestamp_seconds(seq) AS ts", "'u' AS url", "'T' AS error_type", "'m' AS error_msg"
    )
    done, failed = brute_attempts(log)
    state = attempt_state(df).collect()
    assert {r["row_id"] for r in state if r["completed"]} == done
    assert {r["row_id"]: r["last_failure"] for r in state if r["failed"]} == failed
    plan = spark.range(10).selectExpr("'j' AS job_name", "id AS row_id")
    pending = {r["row_id"] for r in pending_rows(plan, df).collect()}
    complete = {r["row_id"] for r in completed_rows(df).collect()}
    assert pending | complete == set(range(10)) and not pending & complete


def test_attach_contacts_keeps_every_listing(spark):
    listings = spark.createDataFrame(
        [(1, "https://a.b", "old@x.y"), (2, "https://a.b", None), (3, "ftp://a.b", "old@x.y"), (4, None, None), (5, " https://a.b ", "")],
        "row_id int, website string, email string",
    )
    found = spark.createDataFrame(
        [("https://a.b", ["n@x.y", "m@x.y"], ["f"], [], [], []), ("https://none", [], [], [], [], [])],
        "website string, email array<string>, facebook array<string>, instagram array<string>, linkedin array<string>, x array<string>",
    )
    out = attach_contacts(listings, found, "row_id")
    assert out.columns == ["row_id", "website", "email", "facebook", "instagram", "linkedin", "x"]
    assert [(r["row_id"], r["email"], r["facebook"]) for r in out.orderBy("row_id").collect()] == [
        (1, "n@x.y, m@x.y", "f"), (2, "n@x.y, m@x.y", "f"), (3, None, None), (4, None, None), (5, "n@x.y, m@x.y", "f"),
    ]


def test_schema_operators(spark):
    df = spark.createDataFrame([("a", "b", "c", None, "e")], "` Web ` string, Correo string, `E-Mail` string, a.b string, x string".replace("a.b", "`a.b`"))
    named = schema.normalize_headers(df)
    assert named.columns == ["web", "correo", "e-mail", "a.b", "x"]
    canon = schema.canonicalize_columns(named)
    assert canon.columns == ["website", "email", "a.b", "x"]
    assert tuple(canon.first()) == ("a", "b", None, "e")
    assert schema.drop_columns(canon, ["a.b", "none"])[1] == 1
    renamed, count = schema.rename_columns(canon, {"x": "y", "y": "z", "none": "q"})
    assert renamed.columns == ["website", "email", "a.b", "z"] and count == 2
    ordered, count = schema.reorder_columns(canon, ["x", "email", "none"])
    assert ordered.columns == ["x", "email", "website", "a.b"] and count == 2
    assert schema.reorder_columns(canon, ["none"])[0].columns == canon.columns
    _, counts = schema.clean_frame(canon, ["x"], {"email": "mail"}, ["mail"])
    assert counts == {"dropped": 1, "renamed": 1, "reordered": 1}


def test_pick_sector_columns(spark):
    assert schema.pick_sector_columns(spark.sql("SELECT 'a' AS q, 1 AS w")).columns == ["Sector", "Number of companies"]
    assert schema.pick_sector_columns(spark.sql("SELECT 'a' AS q, 1 AS w, 2 AS e")) is None


def test_column_roles():
    assert masking.column_roles("Owner_Email") == {"email"}
    assert masking.column_roles("x") == {"social"} and masking.column_roles("tel") == {"phone"}
    assert masking.column_roles("tax") == set() and masking.column_roles("hotel") == set()
    assert masking.column_roles("hotel", legacy_names=True) == {"phone"}
    assert masking.column_roles("tax", legacy_names=True) == {"social"}


def test_mask_sweep_finds_contacts_in_any_column(spark):
    df = spark.createDataFrame(
        [("call 600 123 456", "ann@x.com", "bob@shop123456.net", 123456789, "key1234567")],
        "note string, other string, email string, n bigint, id string",
    )
    assert tuple(masking.mask_sweep(df, keep=["id"]).first()) == (
        "call 600 123 4**", "a**@x.com", "b**@shop123456.n**", 123456789, "key1234567",
    )


def plain_mask(role, v):
    if role == "email":
        name, at, domain = v.partition("@")
        return v if not at or not name else name[0] + "*" * (len(name) - 1) + "@" + domain
    if role == "phone":
        return v[:-2] + "**" if len(v) > 2 else "**"
    if role == "social":
        return v.split("/")[-1][:2] + "****"
    return "".join("*" if c in "aeiouAEIOU" else c for c in v)


def plain_sweep(row, names):
    """The sweep written out for one row, with roles by substring."""
    has = lambda n, *marks: any(m in n for m in marks)
    emails = [has(n, "email") for n in names]
    phones = [has(n, "phone", "tel") for n in names]
    socials = [has(n, "facebook", "instagram", "linkedin", "x", "twitter") for n in names]
    row = list(row)
    for i, name in enumerate(names):
        if row[i] is None:
            continue
        if name == "address":
            row[i] = plain_mask("address", row[i])
        if emails[i] and "@" in row[i]:
            row[i] = plain_mask("email", row[i])
        if phones[i] and any(c.isdigit() for c in row[i]):
            row[i] = plain_mask("phone", row[i])
        if socials[i] and "/" in row[i]:
            row[i] = plain_mask("social", row[i])
        if "@" in row[i] and "." in row[i] and not emails[i]:
            row[i] = plain_mask("email", row[i])
        elif len(row[i]) >= 7 and sum(c.isdigit() for c in row[i]) >= 6 and not phones[i]:
            row[i] = plain_mask("phone", row[i])
    return tuple(row)


def test_mask_sweep_against_a_row_loop(spark):
    rng = random.Random(8)
    names = ["id", "address", "email", "hotel", "phone", "tax", "website", "email_x", "note"]
    cell = lambda: rng.choice([None, "".join(rng.choice("aB1234567@./ ") for _ in range(rng.randint(0, 14)))])
    data = [tuple([f"{i:05d}"] + [cell() for _ in names[1:]]) for i in range(1500)]
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    got = masking.mask_sweep(df, legacy_names=True, legacy_email=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((plain_sweep(r, names) for r in data), key=str)


def test_numeric_phones_are_masked(spark):
    df = spark.sql("SELECT 600123456L AS phone, 12 AS reviews")
    for masked in (masking.mask_table(df), masking.mask_sweep(df)):
        assert tuple(masked.first()) == ("6001234**", 12)


def test_mask_report_fails_closed(spark):
    with pytest.raises(ValueError):
        masking.mask_report({"statistics": spark.range(1)})


def test_contact_stats_without_optional_columns(spark):
    out = stats.contact_stats(spark.createDataFrame([("a@x.y, b@x.y",), ("a@x.y",), (None,)], "email string")).first()
    assert (out["companies"], out["unique_emails"], out["phones"], out["social_networks"]) == (3, 2, 0, 0)
