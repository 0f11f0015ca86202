"""Files, streams and jobs."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from listwright.config import COLUMN_ORDER, DROP_COLUMNS, RENAME_COLUMNS
from listwright.operators import contacts as contact_ops
from listwright.operators.attempts import attempt_state
from listwright.operators.progress import throughput
from listwright.plans import flows
from listwright.session import shared_dir
from listwright.sources import listing_files, readers, writers
from listwright.streaming import streams
from tests.conftest import rows


def put(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.write(content)


def test_read_listings_skips_only_long_lines(spark, tmp_path):
    put(tmp_path, "a.csv", 'web,correo,tel\nx.com,a,1\ny.com,b\nx.com,c,2,extra\nx.com,c,2,\nz.com,"d,e",3\n\nw.com,"q ""r""",NA\n')
    df = readers.read_listings(spark, str(tmp_path / "a.csv"), ["website", "email", "phone"])
    want = [("x.com", "a", "1"), ("y.com", "b", None), ("z.com", "d,e", "3"), ("w.com", 'q "r"', None)]
    assert rows(df) == sorted(want, key=str)
    # Neither counting nor pruning brings a skipped line back.
    assert df.count() == 4 and df.select("email").where("email = 'c'").count() == 0


def random_csv(rng):
    def field():
        raw = "".join(rng.choice('ab,"  é') for _ in range(rng.randint(0, 5))) if rng.random() < 0.7 else rng.choice(["NA", "null", "1", "nan", "-", "NaN "])
        quoted = rng.random() < 0.3 or "," in raw or '"' in raw
        return '"' + raw.replace('"', '""') + '"' if quoted else raw

    lines = ["h1,h2,h3", "x,y,z"]
    for _ in range(60):
        fields = [field() for _ in range(rng.choice([1, 2, 3, 3, 3, 3, 4, 5]))]
        lines.append(",".join(fields))
    return "\n".join(lines) + "\n"


def test_read_listings_reads_as_pandas_does(spark, tmp_path):
    for seed in range(12):
        path = tmp_path / f"{seed}.csv"
        put(tmp_path, path.name, random_csv(random.Random(seed)))
        theirs = pd.read_csv(path, encoding="utf-8", on_bad_lines="skip", dtype=str)
        want = [tuple(None if pd.isna(v) else v for v in r) for r in theirs.itertuples(index=False)]
        ours = readers.read_listings(spark, str(path), ["h1", "h2", "h3"], ordinal=True)
        got = [tuple(r) for r in ours.orderBy("ordinal").select("h1", "h2", "h3").collect()]
        # A line without any text is a blank line to one reader and an empty row to the other.
        blank = (None, None, None)
        assert [r for r in got if r != blank] == [r for r in want if r != blank], seed


def test_folder_with_different_headers(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "one.csv", "Nombre,Sitio Web,Correo\nA,WWW.a.com,i@a.com\nB,www.a.com/,\nC, www.A.com,second\n")
    put(folder, "two.CSV", "Correo,Web,E-mail,query\n,b.com,alt@b.com,q\nx@b.com,B.com,,q\n,,,q\n")
    put(folder, "empty.csv", "")
    put(folder, "note.txt", "Web\nz.com\n")
    read = readers.read_listing_folder(spark, str(folder))
    assert set(read.columns) == {"name", "website", "email", "query", "source_file", "ordinal"}
    assert read.count() == 6
    cleaned = flows.clean_job(spark, str(folder)).select("name", "website", "email")
    assert rows(cleaned) == sorted(
        [("A", "https://www.a.com", "i@a.com"), ("B", "https://www.a.com/", None), (None, "https://b.com", "alt@b.com")], key=str
    )
    assert "query" not in flows.clean_job(spark, str(folder)).columns
    first = [r["path"] for r in readers.file_inventory(spark, str(folder)).collect() if r["path"].endswith("one.csv")]
    assert readers.read_listing_folder(spark, str(folder), skip=first).count() == 3


def test_headers_are_read_to_their_end(spark, tmp_path):
    names = [f"a_rather_long_column_name_{k}" for k in range(6000)]
    put(tmp_path / "in", "wide.csv", "Web," + ",".join(names) + ',"a ""quoted"",\nname",email\na.com' + "," * 6000 + ',x,e@a.com\n')
    read = readers.read_listing_folder(spark, str(tmp_path / "in"))
    assert len(read.columns) == 6003 + 2
    assert rows(read.select("website", "email")) == [("a.com", "e@a.com")]
    heads = readers.file_headers(spark, readers.file_inventory(spark, str(tmp_path / "in"), [".csv"]))
    assert readers.header_names(heads.first()["header"])[-2:] == ['a "quoted",\nname', "email"]
    put(tmp_path / "q", "q.csv", 'a,"b, website",c\n1,2,3\n')
    put(tmp_path / "q", "r.csv", 'a,"web""site"\n1,2\n')
    heads = readers.file_headers(spark, readers.file_inventory(spark, str(tmp_path / "q"), [".csv"]))
    assert readers.validate_source(heads).count() == 0
    assert readers.validate_source(heads, "b, website").count() == 1 == readers.validate_source(heads, 'web"site').count()


def test_wide_rows_leave_a_task_in_small_batches(spark, tmp_path):
    assert listing_files.batch_rows(6003) * 6003 <= listing_files.FIELDS_OUT and listing_files.batch_rows(7) == listing_files.ROWS_OUT
    assert listing_files.batch_rows(10**9) == 1
    names = [f"column_{k}" for k in range(3000)]
    n = 2 * listing_files.batch_rows(3002) + 5
    put(tmp_path / "in", "wide.csv", "Web," + ",".join(names) + ",email\n" + "".join(f"{k}.com" + "," * 3001 + f"e{k}\n" for k in range(n)))
    read = readers.read_listing_folder(spark, str(tmp_path / "in"))
    assert rows(read.select("website", "email")) == sorted([(f"{k}.com", f"e{k}") for k in range(n)], key=str)
    assert read.select("ordinal").distinct().count() == n


def test_long_quoted_text_in_an_irregular_line(spark, tmp_path):
    text = "x, y " * 200_000 + '""said"" '
    put(tmp_path, "a.csv", f'website,email,phone\na.com,"{text}"\nb.com,"{text}",1,2\n')
    df = readers.read_listings(spark, str(tmp_path / "a.csv"), ["website", "email", "phone"])
    assert rows(df.select("website", F.length("email"))) == [("a.com", len(text) - 2)]


def test_bad_lines(spark, tmp_path):
    put(tmp_path, "a.csv", "website,email\na.com,x\nb.com,y,z\nc.com\n")
    path, columns = str(tmp_path / "a.csv"), ["website", "email"]
    assert rows(readers.read_listings(spark, path, columns).select("website")) == [("a.com",), ("c.com",)]
    assert rows(readers.rejected_lines(spark, path, columns).select("line")) == [("b.com,y,z",)]
    with pytest.raises(Exception, match="more than 2 fields"):
        readers.read_listings(spark, path, columns, on_bad_lines="error").collect()
    with pytest.raises(ValueError):
        readers.read_listings(spark, path, columns, on_bad_lines="warn")
    put(tmp_path / "d.csv", "b.csv", "email,website\nx,a.com\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_listings(spark, str(tmp_path / "d.csv"), columns, same_header=True).collect()


def test_mask_file_fails_closed(spark, tmp_path):
    put(tmp_path / "l.csv", "one.csv", "email,name\nann@x.org,Ann\n")
    put(tmp_path / "l.csv", "two.csv", "name,email,note\nBob,bob@y.org,see me@z.org\n")
    out = flows.mask_file(spark, str(tmp_path / "l.csv"))
    text = "".join(r["value"] for r in spark.read.text(out).collect())
    assert not any(x in text for x in ("ann@", "bob@", "me@")) and "Bob" in text
    put(tmp_path / "bad.csv", "one.csv", "email,name\nann@x.org,Ann,more\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        flows.mask_file(spark, str(tmp_path / "bad.csv"))


def test_listing_stream_refuses_another_header(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "email,name\nann@x.org,Ann\n")
    put(tmp_path / "in", "b.csv", "name,email\nBob,bob@y.org\n")
    listing = streams.listing_stream(spark, str(tmp_path / "in"), ["email", "name"], [], same_header=True)
    with pytest.raises(Exception, match="error while reading file .*b.csv"):
        streams.write_stream(listing, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


def test_full_flow_goes_on_where_it_stopped(spark, tables, tmp_path):
    put(tmp_path / "in", "a.csv", "web,email\na.com,\nb.com,\n")
    pages = spark.createDataFrame([("https://a.com", "<p>x@a.com legal@a.com</p>")], "url string, html string")
    words = spark.createDataFrame([(" LEGAL ",), (None,)], "token string")
    out = str(tmp_path / "out")
    first = rows(flows.full_flow(spark, str(tmp_path / "in"), pages, words, out)["data"].select("website", "email"))
    assert [(w, e) for w, e in first] == [("https://a.com", "x@a.com"), ("https://b.com", None)]
    nothing = spark.createDataFrame([], "url string, html string")
    again = flows.full_flow(spark, str(tmp_path / "in"), nothing, words, out)
    assert rows(again["data"].select("website", "email")) == first


def test_same_site_in_two_files_stays_in_both(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        put(tmp_path / "in", name, "web\na.com\nA.com\n")
    assert flows.clean_job(spark, str(tmp_path / "in")).count() == 2


def test_first_row_of_a_split_file_survives(spark, tmp_path):
    lines = "".join(f"s{i % 50}.com,{i}\n" for i in range(20_000))
    put(tmp_path / "in", "big.csv", "web,n\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = flows.clean_job(spark, str(tmp_path / "in")).select("website", F.col("n").cast("int"))
        assert rows(out) == sorted(((f"https://s{i}.com", i) for i in range(50)), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_validate_source(spark, tmp_path):
    put(tmp_path / "in", "good.csv", 'a,"Website"\n1,2\n')
    put(tmp_path / "in", "bad.csv", "a,b\n1,2\n")
    put(tmp_path / "in", "none.csv", "")
    heads = readers.file_headers(spark, readers.file_inventory(spark, str(tmp_path / "in"), [".csv"]))
    assert [os.path.basename(r["path"]) for r in readers.validate_source(heads).collect()] == ["good.csv"]


def test_tokens_and_lines(spark, tmp_path):
    put(tmp_path / "t", "a.txt", " Ana \n\n\tSPAM\n")
    put(tmp_path / "t", "b.txt", "ana\nopt-out\n")
    put(tmp_path / "t", "c.csv", "other\n")
    assert rows(readers.load_tokens(spark, str(tmp_path / "t"))) == [("ana",), ("opt-out",), ("spam",)]


def test_config_texts():
    assert readers.parse_rename_map("a:b\n\nno colon\n c : d:e \n") == {"a": "b", "c": "d:e"}
    assert readers.config_lines(" a \n\nb") == ["a", "b"]
    assert len(COLUMN_ORDER) == 21 and len(DROP_COLUMNS) == 6 and len(RENAME_COLUMNS) == 2


def test_output_name():
    assert writers.output_name("d/a.csv") == "d/a_demo.csv"
    assert writers.output_name("d/a_demo.csv") == "d/a_demo.csv"
    assert writers.output_name("a.b.parquet", "_clean") == "a.b_clean.parquet"
    with pytest.raises(ValueError):
        writers.output_name("a.doc")


def test_report_round_trip(spark, tmp_path):
    report = {"sectors": spark.range(2), "statistics": spark.range(1), "data": spark.range(5)}
    writers.write_report(report, str(tmp_path / "r"))
    back = writers.read_report(spark, str(tmp_path / "r"), list(report))
    assert list(back) == ["data", "statistics", "sectors"] and back["data"].count() == 5
    merged = writers.copy_other_sheets({"data": spark.range(1)}, report)
    assert set(merged) == {"data", "sectors"}


def test_replace_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_in_place(spark.range(10), path)
    for _ in range(2):
        writers.replace_in_place(writers.read_current(spark, path).selectExpr("id + 1 AS id"), path)
    assert sorted(r[0] for r in writers.read_current(spark, path).collect()) == list(range(2, 12))
    # A version that was never finished is not seen, and is written anew.
    spark.range(3).write.parquet(f"{path}/v4")
    assert writers.read_current(spark, path).count() == 10
    writers.replace_in_place(writers.read_current(spark, path).limit(4), path)
    assert writers.read_current(spark, path).count() == 4


def test_notice_table(spark):
    assert rows(writers.notice_table(spark, "a\n\n  b")) == [(0, "a"), (1, ""), (2, "  b")]


def test_shared_dir_follows_the_cluster_setting(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def batches(df, folder, parts):
    df.repartition(parts, "row_id").write.parquet(folder)


def test_attempt_stream_equals_batch(spark, tables, tmp_path):
    base = str(tmp_path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tables.attempts.schema.fields)
    # Half of the log first, the rest after a restart from the checkpoint.
    for half in (0, 1):
        tables.attempts.where(f"seq % 2 = {half}").repartition(3).write.mode("append").parquet(f"{base}/in")
        log = streams.parquet_stream(spark, f"{base}/in", schema, files_per_batch=1)
        streams.attempt_state_stream(log, f"{base}/out", f"{base}/cp").awaitTermination()
    assert len([d for d in os.listdir(f"{base}/out") if d.startswith("batch_id=")]) == 6
    columns = ["job_name", "row_id", "first_success", "last_failure", "completed", "failed"]
    assert rows(streams.read_attempt_state(spark, f"{base}/out").select(columns)) == rows(
        attempt_state(tables.attempts).select(columns)
    )


def test_progress_stream_equals_batch(spark, tables, tmp_path):
    base = str(tmp_path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tables.attempts.schema.fields)
    tables.attempts.repartition(4).write.parquet(f"{base}/in")
    log = streams.parquet_stream(spark, f"{base}/in", schema, files_per_batch=2)
    streams.progress_stream(log, f"{base}/out", f"{base}/cp").awaitTermination()
    want = throughput(tables.attempts)
    assert rows(streams.read_progress(spark, f"{base}/out").select(want.columns)) == rows(want)
    for _ in range(2):
        streams.compact_updates(spark, f"{base}/out", ["job_name"])
        assert rows(streams.read_progress(spark, f"{base}/out").select(want.columns)) == rows(want)
    plan = streams.read_progress(spark, f"{base}/out")._jdf.queryExecution().executedPlan().toString()
    assert "batch_id" in plan and "PartitionFilters: [isnotnull(batch_id" in plan


def test_ttl_dedupe_drops_repeats(spark, tmp_path):
    base = str(tmp_path)
    spark.sql(
        "SELECT concat('k', id % 3) AS key, timestamp_seconds(id) AS ts FROM range(30)"
    ).coalesce(1).write.parquet(f"{base}/in")
    events = streams.parquet_stream(spark, f"{base}/in", "key string, ts timestamp")
    streams.write_stream(streams.ttl_dedupe(events, "key", "ts", "1 hour"), f"{base}/out", f"{base}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/out").select("key")) == [("k0",), ("k1",), ("k2",)]


def test_ttl_misses_follow_the_lifetimes(spark, tmp_path):
    base = str(tmp_path)
    rng = random.Random(9)
    events = sorted((rng.randint(0, 50_000), rng.choice(["hot", "hot", "a", "b"]), i) for i in range(300))
    live, want = {}, []
    for t, k, i in events:
        if not live.get(k, -1) > t:
            live[k] = t + 1000
            want.append((k, i))
    # Files arrive in time order, one per micro-batch, with a restart in between.
    df = spark.createDataFrame(events, "t long, key string, id int").select("key", "id", F.timestamp_seconds("t").alias("ts"))
    for part in range(4):
        lo, hi = part * 12_500, (part + 1) * 12_500 + (part == 3)
        chunk = df.where((F.unix_seconds("ts") >= lo) & (F.unix_seconds("ts") < hi))
        chunk.coalesce(1).write.mode("append").parquet(f"{base}/in")
        log = streams.parquet_stream(spark, f"{base}/in", "key string, id int, ts timestamp", files_per_batch=1)
        found = streams.ttl_misses(log, "key", "id", "ts", 1000, "10 seconds")
        streams.write_stream(found, f"{base}/out", f"{base}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/out").select("key", "id")) == sorted(want, key=str)


def test_extract_job_resumes_and_prefers_the_last_fetch(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.b", "old@a.b"), (2, "https://a.b", "new@a.b"), (1, "https://c.d", "c@c.d")], "n int, url string, html string"
    )
    listings = spark.createDataFrame(
        [("j", 1, "https://a.b", "s"), ("j", 2, "https://c.d", "s"), ("j", 3, "https://a.b", "t")],
        "job_name string, row_id int, website string, main_category string",
    )
    attempts = spark.sql("SELECT 'j' AS job_name, 3 AS row_id, true AS success, 'u' AS url")
    report = flows.extract_job(
        listings, pages, "row_id", notice="a\nb", attempts=attempts, page_order=F.col("n")
    )
    assert set(report) == {"data", "statistics", "sectors", "copyright"}
    assert rows(report["data"].select("row_id", "email")) == [(1, "new@a.b"), (2, "c@c.d"), (3, None)]
    assert rows(report["sectors"]) == [("s", 2), ("t", 1)]
    stored = spark.createDataFrame([(3, "kept@a.b"), (3, "kept@a.b"), (9, "no@no.no")], "row_id int, email string")
    again = flows.extract_job(listings, pages, "row_id", attempts=attempts, stored=stored, page_order=F.col("n"))["data"]
    assert rows(again.select("row_id", "email")) == [(1, "new@a.b"), (2, "c@c.d"), (3, "kept@a.b")]


def test_pages_that_nobody_asks_for_are_not_scanned(spark):
    pages = spark.createDataFrame([("https://a.b", "x@a.b"), ("https://z.z", "z@z.z")], "url string, html string")
    listings = spark.createDataFrame([(1, " https://a.b "), (2, None)], "row_id int, website string")
    data = flows.extract_data(listings, pages, "row_id")
    assert rows(data.select("row_id", "email")) == [(1, "x@a.b"), (2, None)]


def test_a_site_fetched_twice_keeps_one_row(spark):
    contacts = spark.createDataFrame(
        [("https://a.b", ["x@a.b"], [], [], [], [])] * 2 + [("https://a.b", ["a@a.b"], [], [], [], [])],
        "website string, email array<string>, facebook array<string>, instagram array<string>, linkedin array<string>, x array<string>",
    )
    listings = spark.createDataFrame([(1, "https://a.b")], "row_id int, website string")
    out = contact_ops.attach_contacts(listings, contacts, "row_id")
    assert rows(out.select("row_id", "email")) == [(1, "x@a.b")]


def test_auto_flow_keeps_the_file_name(spark):
    data = spark.createDataFrame(
        [("in/file1234567.csv", "ann@x.com, legal@x.com", "w"), ("in/b.csv", None, "w")], "source_file string, email string, website string"
    )
    report = flows.auto_flow(data, ["legal"])
    assert rows(report["data"]) == [("in/b.csv", None, "w"), ("in/file1234567.csv", "a**@x.com", "w")]
    assert rows(report["statistics"].select("source_file", "companies", "unique_emails")) == [
        ("in/b.csv", 1, 0), ("in/file1234567.csv", 1, 1),
    ]


def test_exclusion_job_needs_data(spark):
    with pytest.raises(ValueError):
        flows.exclusion_job({}, ["a"])
