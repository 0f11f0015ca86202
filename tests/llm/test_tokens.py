import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listwright.llm import encoding, packed, packing
from listwright.llm.common import shared_dir
from listwright.llm.encoding import Encoder
from tests.conftest import SF

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a  b", "a \n b\n\n c", "x\t y", "\n\nfoo bar's 12 ab12", " lead", "trail ", "tail\n", "é́ ǅ Σας ΑΣ İi", "<|endoftext|> x",
    "a b   c", "x\x1c y", "don't  I'll\nA  B", "a\0b c", "...,,. a., b", "naïve café.", " x  y", "日本語 text。", "ab\r\ncd ef.",
]


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def pair(request):
    plain = Tokenizer.from_file(request.param)
    plain.encode_special_tokens = True
    return Encoder(request.param), plain


def assert_same(pair, texts):
    enc, plain = pair
    ids, sizes = enc.encode(texts)
    want = [x.ids for x in plain.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_encoder_equals_library(pair, docs):
    assert pair[0].cut is not None
    assert_same(pair, [*ODD, None])
    assert_same(pair, [r["text"] for r in docs.select("text").collect()])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,'\n\t 1ßΣ́ |-"), max_size=5))
def test_encoder_on_any_text(texts):
    for path in (BYTES, WORDS):
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        assert_same((ENCODERS[path], plain), texts)


ENCODERS = {x: Encoder(x, words=50) for x in (BYTES, WORDS)}


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 40))
def test_bits_round_trip(bits, values, block):
    ids = np.array(values, np.uint64) & np.uint64((1 << bits) - 1)
    ids = ids.astype(np.uint32)
    sizes = [len(ids) // 3, len(ids) - len(ids) // 3]
    one = packed.Segment(packed.segment([7, None], sizes, ids, bits, block))
    assert one.ids(0, len(ids)).tolist() == ids.tolist()
    assert one.document(0).tolist() == ids[: sizes[0]].tolist() and one.document(1).tolist() == ids[sizes[0] :].tolist()
    assert one.known.tolist() == [True, False]
    for a in range(0, len(ids), 37):
        assert one.ids(a, min(len(ids), a + 5)).tolist() == ids[a : a + 5].tolist()
    with pytest.raises(IndexError):
        one.ids(0, len(ids) + 1)


def test_bits():
    assert [packed.bits_for(x) for x in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        packed.Segment(b"no such file" * 9)


def test_packed_files(spark, awkward, nothing):
    path = shared_dir(spark, "test-packed")
    packed.write_packed(awkward, path, BYTES, end_id=2, segment_ids=10)
    assert spark.read.parquet(path).count() > 3
    rows = sorted(packed.read_packed(spark, path).collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_file(BYTES)
    source = sorted(awkward.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, everything = 0, []
    for r, (doc_id, text) in zip(rows, source, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at, everything = at + len(ids), everything + ids
    some = sorted(packed.read_ids(spark, path, 30, 5000).collect())
    assert [(r["place"], r["id"]) for r in some] == list(enumerate(everything))[30:5030]
    path = shared_dir(spark, "test-packed")
    packed.write_packed(nothing, path, BYTES, end_id=2)
    assert packed.read_packed(spark, path).count() == 0


def test_no_doc_id_is_bound_to_one_task(spark):
    rows = [(None, f"text {k % 50}" + " long" * (k % 60)) for k in range(300)] + [(7, "the same text")] * 300 + [(k, f"other {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = shared_dir(spark, "test-packed")
    dealt = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed.write_packed(docs, path, BYTES, end_id=2, segment_ids=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", dealt)
    written = spark.read.parquet(path).collect()
    tasks = {}
    for r in written:
        image = packed.Segment(r["image"])
        for known, doc_id in zip(image.known.tolist(), image.doc_ids.tolist(), strict=True):
            tasks.setdefault(doc_id if known else None, Counter())[r["part"]] += 1
    parts = {r["part"] for r in written}
    assert len(tasks[None]) > 1 and len(tasks[7]) > 1
    assert max(sum(x[p] for x in tasks.values()) for p in parts) < 1.3 * len(rows) / len(parts)
    got = sorted(packed.read_packed(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r["doc_id"] for r in got] == [k for k, _ in order]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    plain = Tokenizer.from_file(BYTES)
    assert [r["ids"] for r in got] == [[*plain.encode(x, add_special_tokens=False).ids, 2] for _, x in order]


def test_a_range_takes_only_its_segments(spark):
    docs = spark.createDataFrame([(k, f"text number {k} of many") for k in range(500)], "doc_id long, text string")
    path = shared_dir(spark, "test-packed")
    packed.write_packed(docs, path, BYTES, end_id=2, segment_ids=64)
    flat = [x for r in sorted(packed.read_packed(spark, path).collect(), key=lambda r: r["start"]) for x in r["ids"]]
    for start, count in ((0, 1), (1000, 10), (500, 900), (len(flat) - 3, 50), (len(flat), 5), (10, 0)):
        few = packed.segments_between(spark, path, start, start + count)
        assert few.count() <= count // 64 + 2
        found = packed.read_ids(spark, path, start, count)
        assert [(r["place"], r["id"]) for r in sorted(found.collect())] == list(enumerate(flat))[start : start + count]
    few = packed.segments_between(spark, path, 1000, 1010)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(seg" in plan and "LessThanOrEqual(part" in plan


def test_packed_query(spark, docs):
    rows = {r["doc_id"]: r for r in packed.op2_packed_ids(spark, SF).collect()}
    plain, at = Tokenizer.from_file(BYTES), 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert rows[r["doc_id"]]["start"] == at
        assert rows[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def check_packing(rows, docs, size, plain, end_id):
    want = Counter()
    for doc_id, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, end_id]
        for k, a in enumerate(range(0, len(ids), size)):
            part = ids[a : a + size]
            want[doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values(), default=0) <= size
    return len(ends), sum(ends.values())


@pytest.mark.parametrize("size", [16, 100, 2048])
def test_packing(spark, awkward, size):
    rows = packing.pack_documents(awkward, WORDS, 0, size, with_ids=True).collect()
    source = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    check_packing(rows, source, size, Tokenizer.from_file(WORDS), 0)
    assert all(len(r["ids"]) == r["length"] for r in rows)


def test_packing_nothing(spark, nothing):
    assert packing.pack_documents(nothing, WORDS, 0).count() == 0


def test_packing_query(spark, docs):
    source = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n, tokens = check_packing(packing.op6_packing(spark, SF).collect(), source, 2048, Tokenizer.from_file(WORDS), 0)
    assert n <= 1.02 * tokens / 2048 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 200), max_size=20))
def test_plans_hold_every_length(histogram):
    plan = packing.plan_packing(histogram, 64, bins=16)
    assert plan.used == {k: v for k, v in histogram.items() if v}
    load = Counter()
    for length, spans in plan.spans.items():
        for k, (first, base, each) in enumerate(spans):
            end = spans[k + 1][0] if k + 1 < len(spans) else histogram[length]
            for r in range(first, end):
                load[base + (r - first) // each] += length
    assert len(load) == plan.sequences and max(load.values(), default=0) <= 64


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_best_fit_on_counts_equals_one_by_one(histogram):
    rooms = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        rooms.remove(best := min(fits)) if fits else None
        rooms.append((best if fits else 50) - length)
    lots = packing.best_fit(histogram, 50)
    assert sum(n for n, _ in lots) == len(rooms)
    assert Counter(50 - sum(x * m for x, m in items) for n, items in lots for _ in range(n)) == Counter(rooms)


def test_least_squares():
    rng = np.random.default_rng(4)
    a, x = rng.random((20, 12)), np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.non_negative_least_squares(a, a @ x), x, atol=1e-6)
    b = rng.normal(size=20)
    got = packing.non_negative_least_squares(a, b)
    slope = a.T @ (b - a @ got)
    assert (got >= 0).all() and (slope <= 1e-6).all() and np.allclose(slope[got > 0], 0, atol=1e-6)


def test_patterns_fill_a_sequence():
    found = packing.patterns(9)
    assert len(found) == len(set(found)) and all(sum(x) == 9 and list(x) == sorted(x, reverse=True) for x in found)
    assert (4, 3, 2) in found and (9,) in found and (5, 4) in found


SPECIAL = [
    "foo <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\n<|startoftext|> y. ", "<|ENDOFTEXT|> <|endoftext|",
    "don<|endoftext|>'t  x", "é<|startoftext|>́ É", "two  <|endoftext|>  blanks", "<|end<|endoftext|>oftext|>", "plain text.", "\0<|endoftext|>\0", "", None,
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_special_tokens_are_the_librarys(path):
    enc, plain = encoding.encoder(path), Tokenizer.from_file(path)
    assert enc.cut is not None
    assert plain.token_to_id("<|endoftext|>") in enc.encode(["foo <|endoftext|> x"])[0]
    assert_same((enc, plain), SPECIAL)
    assert_same((enc, plain), [*ODD, *(f"{x}<|endoftext|>{y}" for x in ODD for y in ODD)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n", "a", "B", "'s", "é", "\u0301", "Σ", ".", "1"]), max_size=9).map("".join), max_size=5))
def test_special_tokens_anywhere(texts):
    for path in (BYTES, WORDS):
        assert_same((encoding.encoder(path), Tokenizer.from_file(path)), texts)


def test_special_tokens_in_files_and_sequences(spark):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(SPECIAL * 3)], "doc_id long, text string").repartition(3)
    path = shared_dir(spark, "test-packed-special")
    packed.write_packed(docs, path, BYTES, end_id=2)
    plain, at = Tokenizer.from_file(BYTES), 0
    for r in sorted(packed.read_packed(spark, path).collect(), key=lambda r: r["doc_id"]):
        ids = [*plain.encode((SPECIAL * 3)[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = packing.pack_documents(docs, WORDS, 0, 16).collect()
    check_packing(rows, [tuple(r) for r in docs.collect()], 16, Tokenizer.from_file(WORDS), 0)
