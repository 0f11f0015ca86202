"""Listing files of any header, broken files, hashes of files, ranks, adaptive slots and mergeable statistics."""

import csv
import hashlib
import io
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from listwright.operators import cache as cache_ops
from listwright.operators import stats
from listwright.operators.attempts import attempt_state
from listwright.operators.ranks import with_place
from listwright.plans import flows
from listwright.sources import file_digests, listing_files, readers
from listwright.streaming import streams
from tests.conftest import rows


def put(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as out:
        out.write(content if isinstance(content, bytes) else content.encode())


def random_listing(rng, eol):
    """A file with fields of all sorts; returns its text and what pandas makes of it."""
    names = rng.sample(["Web", "Correo", "Nombre", "reviews", "Dir.", "Móvil"], rng.randint(2, 5))
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=eol)
    writer.writerow(names)
    writer.writerow(["first"] * len(names))  # else pandas takes a long first line for one with an index
    for _ in range(rng.randint(0, 40)):
        writer.writerow([rng.choice(["a,b", 'say "x"', "plain", "NA", "", " pad ", "é日", "1"]) for _ in range(rng.choice([1, 2, len(names), len(names), len(names) + 1]))])
    text = out.getvalue()
    return text, pd.read_csv(io.StringIO(text), dtype=str, on_bad_lines="skip")


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_ranges_read_each_line_once(monkeypatch, size):
    monkeypatch.setattr(listing_files, "READ_BYTES", 5)
    for data in (b"", b"\n", b"a\nb\n", b"a\r\nbb\r\n\r\nccc", b"one\rtwo\r\nthree\n\rfour", b"x" * 50 + b"\r\n" + b"y" * 20, b"\n\n\n", b"no end"):
        got = []
        for start in range(0, max(len(data), 1), size):
            got += [line for _, line in listing_files.lines_between(io.BytesIO(data), start, start + size)]
        want = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        assert got == (want[:-1] if want[-1] == b"" else want), data


@pytest.mark.parametrize("size", [50, 1 << 26])
def test_mixed_folder_reads_as_pandas_does(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(listing_files, "RANGE_BYTES", size)
    rng = random.Random(size)
    want = []
    for k in range(25):
        text, frame = random_listing(rng, rng.choice(["\n", "\r\n"]))
        put(tmp_path / "in", f"{k}.csv", text.encode("utf-8-sig" if k % 5 == 0 else "utf-8"))
        frame.columns = listing_files.canonical_names(list(frame.columns))
        for r in frame.to_dict("records"):
            want.append((k, *(None if pd.isna(r.get(c, None)) else r[c] for c in ("website", "email", "name", "reviews", "address", "phone"))))
    read = readers.read_listing_folder(spark, str(tmp_path / "in"))
    number = F.regexp_extract("source_file", "([0-9]+)[.]csv", 1).cast("int")
    got = [tuple(r) for r in read.orderBy(number, "ordinal").select(number, "website", "email", "name", "reviews", "address", "phone").collect()]
    # A line without any text is a blank line to one reader and an empty row to the other.
    full = [r for r in want if any(x is not None for x in r[1:])]
    assert [r for r in got if any(x is not None for x in r[1:])] == full


def test_many_headers_are_one_scan(spark, tmp_path):
    folder = tmp_path / "in"
    for k in range(1500):
        put(folder, f"{k}.csv", f"web,own{k % 300},x{k % 300}\nsite{k}.com,{k},\n")
    read = readers.read_listing_folder(spark, str(folder))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert len(read.columns) == 1 + 600 + 2 and plan.count("FileScan") == 1 and "InMemoryFileIndex(1 paths)" in plan
    found = read.select(F.count("website"), F.count("own7"), F.countDistinct("source_file")).first()
    assert tuple(found) == (1500, 5, 1500)


BROKEN = {
    "cut.csv": ("read", "website,email\na.com,x\nb.com,\"never clo"), "binary.csv": ("read", b"website,email\na.com,\x00\x01\n"),
    "latin.csv": ("read", "website,email\nañb.com,x\n".encode("latin-1")), "headless.csv": ("header", "a.com,first\nb.com,y\n"), "blank.csv": ("header", b"\n\n"),
    "noise.csv": ("header", bytes(range(128, 256)) * 10),
}


def test_broken_files_cost_only_themselves(spark, tmp_path):
    for name, (_, content) in BROKEN.items():
        put(tmp_path / "in", name, content)
    put(tmp_path / "in", "good.csv", 'Web,Correo,a.dotted\ng.com,"ann@x.com, legal@x.com",1\n,only@x.com\n')
    put(tmp_path / "in" / "sub", "other.csv", "correo,nombre\nbob@y.com,Bob\n")
    report = flows.auto_flow_folder(spark, str(tmp_path / "in"), ["legal"])
    assert rows(report["data"].select("website", "email")) == sorted([("g.com", "a**@x.com"), (None, "o***@x.com"), (None, "b**@y.com")], key=str)
    errors = {os.path.basename(r["source_file"]): r["stage"] for r in report["errors"].collect()}
    assert errors == {name: stage for name, (stage, _) in BROKEN.items()}
    assert report["statistics"].select(F.sum("companies")).first()[0] == 3
    with pytest.raises(Exception, match="(?i)utf|fields|close|text|decode|column"):
        listing_files.scan(listing_files.listing_files(spark, str(tmp_path / "in"), "nosuch"), ["website"], on_bad_lines="nonsense")


def test_a_broken_end_takes_the_whole_file(spark, tmp_path, monkeypatch):
    """Other tasks have read the file's good part already."""
    monkeypatch.setattr(listing_files, "RANGE_BYTES", 64)
    put(tmp_path / "in", "long.csv", "website,email\n" + "".join(f"s{k}.com,e{k}\n" for k in range(200)) + 'x.com,"\n')
    put(tmp_path / "in", "good.csv", "email,website\ne,g.com\n")
    data, errors = readers.read_listing_folder_isolated(spark, str(tmp_path / "in"))
    assert rows(data.select("website")) == [("g.com",)] and errors.count() == 1
    first = [r[0] for r in data.select("source_file").collect()]
    again, _ = readers.read_listing_folder_isolated(spark, str(tmp_path / "in"), skip=first)
    assert again.count() == 0


def test_listing_stream_takes_any_header(spark, tmp_path):
    base = str(tmp_path)
    columns = ["website", "email", "name"]
    for k, (name, content) in enumerate([
        ("a.csv", "web,correo\na.com,a@x\n"), ("b.csv", "Nombre,E-mail,URL\nB,b@x,b.com\n"), ("c.csv", b"website\n\xff\xfe\n"),
        ("d.csv", "email,extra,web\nd@x,1,d.com\n,2,e.com\n"),
    ]):
        put(f"{base}/in", name, content)
        if k % 2:  # two files at a time, with a restart in between
            listing = streams.listing_stream(spark, f"{base}/in", columns, [""], files_per_batch=1)
            streams.write_stream(listing, f"{base}/out", f"{base}/cp").awaitTermination()
    data, errors = streams.read_listing_stream(spark, f"{base}/out")
    batch, batch_errors = readers.read_listing_folder_isolated(spark, f"{base}/in", [""])
    assert rows(data.select(columns)) == rows(batch.select(columns)) and data.count() == 4
    assert rows(errors.select("source_file", "stage")) == rows(batch_errors.select("source_file", "stage")) and errors.count() == 1


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    path = tmp_path / "large.bin"
    with open(path, "wb") as out:
        out.truncate((1 << 31) + 5_000_000)
    want = hashlib.md5()
    for at in range(0, (1 << 31) + 5_000_000, 1 << 24):
        want.update(bytes(min(1 << 24, (1 << 31) + 5_000_000 - at)))
    found = readers.file_inventory(spark, str(tmp_path), hashed=True).first()
    assert found["length"] > 1 << 31 and found["content_md5"] == want.hexdigest()


def test_only_files_that_may_have_copies_are_opened(spark, tmp_path, monkeypatch):
    big = b"h" * 70_000
    put(tmp_path / "f", "a.bin", big + b"1")
    put(tmp_path / "f", "b.bin", big + b"1")
    put(tmp_path / "f", "c.bin", big + b"2")
    put(tmp_path / "f", "d.bin", b"x" + big)
    put(tmp_path / "f", "one.bin", b"own size")
    put(tmp_path / "f", "s1.bin", b"same")
    put(tmp_path / "f", "s2.bin", b"same")
    put(tmp_path / "f", "e1.bin", b"")
    put(tmp_path / "f", "e2.bin", b"")
    opened = {}
    kept = file_digests.materialize

    def note(df, name):
        out = kept(df, name)
        opened[name] = sorted(os.path.basename(r["path"]) for r in out.select("path").collect())
        return out

    monkeypatch.setattr(file_digests, "materialize", note)
    found = file_digests.copies(readers.file_inventory(spark, str(tmp_path / "f")))
    assert sorted(os.path.basename(r["path"]) for r in found.collect()) == ["a.bin", "b.bin", "s1.bin", "s2.bin"]
    # Listed: all but empty files. Opened: those that share their size. Read to the end: those that share their beginning.
    assert "one.bin" in opened["listed"] and opened["heads"] == ["a.bin", "b.bin", "c.bin", "d.bin", "s1.bin", "s2.bin"]
    assert opened["digests"] == ["a.bin", "b.bin", "c.bin", "s1.bin", "s2.bin"]
    assert {r["content_md5"] for r in found.collect()} == {hashlib.md5(big + b"1").hexdigest(), hashlib.md5(b"same").hexdigest()}


def test_places_without_one_task(spark):
    df = spark.range(0, 5000, numPartitions=7).select("id", (F.col("id") * 7919 % 13).alias("value"))
    placed = with_place(df, [F.col("value").desc(), F.col("id")])
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    got = [tuple(r) for r in placed.orderBy("place").collect()]
    want = sorted([(r["id"], r["value"]) for r in df.collect()], key=lambda x: (-x[1], x[0]))
    assert got == [(i, v, k + 1) for k, (i, v) in enumerate(want)]
    assert with_place(df.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("most", [5, 40, 10**6])
def test_a_hot_key_within_one_slot_is_cut(spark, most):
    rng = random.Random(most)
    versions = [(rng.choice(["hot", "hot", "a", None]), k, rng.randint(0, 7200)) for k in range(200)]
    requests = [(k, rng.choice(["hot", "hot", "a", "b"]), rng.randint(0, 7200)) for k in range(300)]
    at = F.timestamp_seconds
    cache = spark.createDataFrame(versions, "key string, value long, s long").select("key", "value", at("s").alias("created_at"), at(F.col("s") + 600).alias("expires_at"))
    asked = spark.createDataFrame(requests, "req_id long, key string, s long").select("req_id", "key", at("s").alias("req_ts"))
    got = {r["req_id"]: (r["hit"], r["value"]) for r in cache_ops.cache_lookup(asked, cache, 3600, most).collect()}
    for req, key, t in requests:
        seen = max(((s, v) for k, v, s in versions if k == key and s <= t), default=None)
        hit = seen is not None and t < seen[0] + 600
        assert got[req] == (hit if seen else got[req][0], seen[1] if hit else None), (key, t)
    assert len(got) == 300


def test_adaptive_slots_spread_a_hot_key(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("key"), (F.col("id") * 300_000).alias("_us"))
    parts = cache_ops._adaptive_slots(df, 3_600_000_000, 500).groupBy("_slot").count().collect()
    assert len(parts) >= 20 and max(r["count"] for r in parts) <= 500


def test_statistics_need_no_expand_and_merge(spark):
    df = spark.range(6000).select(
        F.concat(F.lit("f"), F.col("id") % 3).alias("source_file"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("https://s"), F.col("id") % 1500, F.lit(".com/x"))).alias("website"),
        F.concat_ws(", ", F.concat(F.lit("a"), F.col("id") % 2000, F.lit("@x")), F.lit("hot@x")).alias("email"), F.when(F.col("id") % 2 == 0, "1").alias("phone"),
        *[F.when(F.col("id") % 7 == 0, "y").alias(n) for n in ("facebook", "instagram", "linkedin", "x")],
    )
    exact = stats.contact_stats_by(df, "source_file")
    assert "Expand" not in exact._jdf.queryExecution().executedPlan().toString()
    whole = stats.contact_stats(df).first()
    assert (whole["companies"], whole["unique_emails"], whole["phones"], whole["domains"]) == (6000, 2001, 3000, 1200)
    # Sketches of single files, stored and merged, give the statistics of all and of each.
    sketches = stats.contact_sketches(df, "source_file")
    merged = stats.merged_contact_stats(sketches).first()
    for name in whole.asDict():
        assert abs(merged[name] - whole[name]) <= 0.02 * whole[name], name
    own = {r["source_file"]: r for r in stats.merged_contact_stats(sketches, "source_file").collect()}
    for r in exact.collect():
        assert abs(own[r["source_file"]]["unique_emails"] - r["unique_emails"]) <= 0.02 * r["unique_emails"] and own[r["source_file"]]["phones"] == r["phones"]
    assert stats.contact_stats(df.limit(0)).first()["companies"] == 0 == stats.merged_contact_stats(sketches.limit(0)).first()["domains"]


def test_attempt_stream_keeps_no_state(spark, tables, tmp_path):
    base = str(tmp_path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tables.attempts.schema.fields)
    columns = ["job_name", "row_id", "first_success", "last_failure", "failure", "completed", "failed"]
    for half in (0, 1):
        tables.attempts.where(f"seq % 2 = {half}").repartition(2).write.mode("append").parquet(f"{base}/in")
        log = streams.parquet_stream(spark, f"{base}/in", schema, files_per_batch=1)
        query = streams.attempt_state_stream(log, f"{base}/out", f"{base}/cp")
        query.awaitTermination()
        assert all(not p["stateOperators"] for p in query.recentProgress)
        streams.compact_attempt_state(spark, f"{base}/out")
    assert rows(streams.read_attempt_state(spark, f"{base}/out").select(columns)) == rows(attempt_state(tables.attempts).select(columns))
