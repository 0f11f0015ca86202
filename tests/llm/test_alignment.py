import os
import subprocess
import sys
import tracemalloc
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from listwright.llm import alignment, queries
from listwright.llm.alignment import Aligner, align_documents
from listwright.llm.encoding import BYTES
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "plain words, and more.", "two  spaces   and\ttabs \t end ", "a\nb\n\nc \n d\r\ne;\r\nf", "héllo wörld naïve", "日本語の文章です。 中文", "emoji 😀🧿👩‍👩‍👧 x", "🧿", "\U0001f9ff\U000e0061",
    "<|endoftext|> <s> </s> <unk> <0x41>", " leading", "   ", " ", "\n", "\n\n", "x\n", "\nx", "  \nx", "▁sign", "a▁b", "", None, "ﬁ Å 　wide space", "nul\0l", "it's we'll 'tis 1234567 3.14", "écombining हि",
    "a" * 400, "ab " * 300, "​﻿zero", "line\x0bvt\x0cff\x1cfs\x85nel ls", "tail\r", "€uro ‘quotes’—dash…", "ключ к словам", "مرحبا بالعالم", "İẞ",
]


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def brute(texts):
    """Whole texts, byte lengths of decoded tokens only, all pairs of tokens."""
    a, b = libraries()
    back = {v: k for k, v in BYTES.items()}
    found = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append(None)
            continue
        ends = [list(accumulate(map(len, x))) for x in (bytes_a, bytes_b)]
        starts = [[y - len(z) for y, z in zip(e, x, strict=True)] for e, x in zip(ends, (bytes_a, bytes_b), strict=True)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(map(str, ids[bisect_right(x, low) : bisect_right(x, high)])) for ids, x in zip((ids_a, ids_b), ends, strict=True)))
            low = high
        links = [
            (ids_a[i], ids_b[j]) for i in range(len(ids_a))
            for j in range(bisect_right(ends[1], starts[0][i]), bisect_left(starts[1], ends[0][i]))
        ]
        found.append((len(ids_a), len(ids_b), ";".join(groups), links))
    counts = Counter(x for f in found if f for x in f[3])
    best = defaultdict(int)
    for (_, k), n in counts.items():
        best[k] = max(best[k], n)
    return [
        (0,) * 6 + ("",) if f is None
        else (f[0], f[1], f[2].count("|"), len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[2])
        for f in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("looked_up, cached, size", [(10**6, 10**5, 10**6), (0, 10, 50)])
def test_alignment_equals_brute_force(spark, monkeypatch, looked_up, cached, size):
    texts = [*TEXTS, *TEXTS[:6], "\n".join(x for x in TEXTS if x and "▁" not in x)]
    monkeypatch.setattr(alignment, "SLICE_CHARS", size)
    monkeypatch.setattr(alignment, "aligner", lambda a, b: Aligner(a, b, cached))
    rows = [(k if k % 7 else None, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = align_documents(docs, A, B, looked_up=looked_up)
    want = Counter((rows[k][0], *x) for k, x in enumerate(brute(texts)))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()) == want


def test_words_are_encoded_as_in_whole_texts(docs):
    """Ids of cut texts equal the untouched libraries' on whole ones, also on odd mixtures."""
    import random

    rng = random.Random(1)
    a, b = libraries()
    own = Aligner(A, B)
    assert own.cuts
    odd = [x for x in TEXTS if x] + [" ", "  ", "\n", "\n\n", "\t", "\r", ";", "'s", "é", "日", "9", "_", "́", "x"]
    for text in ["".join(rng.choice(odd) for _ in range(rng.randint(1, 7))) for _ in range(1500)] + [r["text"] for r in docs.limit(40).collect()]:
        words = [w for part in alignment.slices(" " + text, 40) for w in alignment.words_of(part)]
        assert "".join(words) == " " + text
        assert own.a_spans(words)[0] == a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert own.b_spans(words)[0].tolist() == b.encode(text), repr(text)


def test_query_equals_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x[:6], sha256(x[6].encode()).hexdigest() if x[6] else "") for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True))
    got = queries.QUERIES["op12_alignment"](spark, SF)
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS[:6]), r["groups_sha256"]) for r in got.collect()) == want


def test_awkward(spark, awkward, nothing):
    got = align_documents(awkward.withColumnRenamed("part", "block").withColumnRenamed("spans", "groups"), A, B)
    rows = awkward.collect()
    short = [(r["doc_id"], r["text"]) for r in rows if not r["text"] or len(r["text"]) < 1000]
    assert got.count() == len(rows) and got.where("doc_id = 5").first()["n_groups"] > 60_000
    assert Counter((r["doc_id"], r["n_a"]) for r in got.where("doc_id IS NULL OR doc_id != 5").collect()) == Counter((k, x[0]) for (k, _), x in zip(short, brute([t for _, t in short]), strict=True))
    assert align_documents(nothing, A, B).count() == 0
    assert got.select(F.sum("n_links")).first()[0] > 60_000


def test_workers_give_aligners_back():
    alignment.aligner(A, B)
    assert alignment.ALIGNERS
    alignment.forget()
    assert not alignment.ALIGNERS


WORKER = """
import re, sys
from pathlib import Path
from listwright.llm import alignment

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

own = alignment.Aligner(*sys.argv[1:3])
before, pieces = held(), []
alignment.ALIGNERS["a", "b"] = own
for k in range(0, 300_000, 20_000):
    pieces += [bytearray(b"x") * 20_000 for _ in range(200)]
    own.read(["".join(f" w{x}x{x * 7919 % 1000003}" for x in range(k, k + 20_000))])
most = held()
del own
pieces = pieces[::50]  # what is freed lies between what is kept
alignment.forget()
print(before, most, held())
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_forgotten_memory_goes_back_to_the_system():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    told = subprocess.run([sys.executable, "-c", WORKER, A, B], cwd=here, env=os.environ | {"PYTHONPATH": here}, capture_output=True, text=True, timeout=300, check=True).stdout
    before, most, after = map(float, told.split())
    assert most > before + 120 and after < before + 30


def test_steps_on_blocks_hold_little_beside_the_block():
    """A block of a million words; what is made for it, apart from the block itself."""
    words, pairs = 200_000, 10_000
    row = {
        "doc_id": pa.scalar([7, None], pa.list_(pa.int64())), "groups": pa.scalar(["x", "y"], pa.list_(pa.string())),
        "numbers": pa.scalar(np.arange(8).tobytes()), "sizes": pa.scalar(np.array([999_999, 1], "<u4").tobytes()),
        "words": pa.scalar((np.arange(1_000_000) % words).astype("<u4").tobytes()), "pair_sizes": pa.scalar(np.full(words, 4, "<u4").tobytes()),
        "places": pa.scalar((np.arange(4 * words) % pairs).astype("<u4").tobytes()), "pairs": pa.scalar(np.arange(pairs, dtype=np.uint64).tobytes()),
    }
    tracemalloc.start()
    got = alignment.counted_rows(row, np.arange(pairs, dtype=np.uint64), np.arange(pairs), np.arange(pairs) % 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    value = np.arange(4 * words) % pairs
    sums = [np.tile(x.reshape(-1, 4).sum(axis=1), 5) for x in (value % 2, value)]
    want = [[7, 0, 1, 2, 3, *(int(x[:-1].sum()) for x in sums), "x"], [None, 4, 5, 6, 7, *(int(x[-1]) for x in sums), "y"]]
    assert [list(x.values()) for x in got.to_pylist()] == want
    assert most < 30e6


def test_blocks_are_stored_one_by_one(spark, monkeypatch, tmp_path):
    """Each block is a row group with its pairs once, so that neither writer nor reader gathers blocks."""
    monkeypatch.setattr(alignment, "BLOCK_WORDS", 150_000)
    monkeypatch.setattr(alignment, "shared_dir", lambda *_: str(tmp_path / "blocks"))
    monkeypatch.setattr(alignment, "pair_counts", lambda found: spark.createDataFrame([], "a long, b long, links long"))
    rows = [(k, " ".join(f"w{x % 30_011}" for x in range(k * 1013, k * 1013 + 40_000))) for k in range(16)]
    align_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B)
    files = [pq.ParquetFile(x) for x in (tmp_path / "blocks").glob("*.parquet")]
    groups = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert groups == [1] * 4
    for f in files:
        for row in f.read(["pairs", "links", "places"]).to_pylist():
            pairs, links = np.frombuffer(row["pairs"], np.uint64), np.frombuffer(row["links"], np.int64)
            assert len(pairs) == len(links) == len(set(pairs.tolist())) and links.min() > 0
            assert len(row["places"]) > 8 * len(pairs)


@pytest.mark.parametrize("looked_up", [10**6, 0])
def test_blocks_without_words(spark, monkeypatch, looked_up):
    monkeypatch.setattr(alignment, "BLOCK_WORDS", 0)
    texts = [None, "", "▁", "two words", None]
    docs = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(5, "text")
    got = align_documents(docs, A, B, looked_up=looked_up)
    want = Counter((None if k == 3 else k, *x) for k, x in enumerate(brute(texts)))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()) == want


def test_full_by_links():
    """Words of signs that both tokenizers cut finely fill an aligner before its words or characters do."""
    own = Aligner(A, B)
    own.read([" ".join(f"{k}日本語の文章です中文" * 30 for k in range(50))])
    assert own.used > 5_000 and not own.full()
    own.used = alignment.CACHED_LINKS + 1
    assert own.full()
    own.clear()
    assert not own.full()


class Asked:
    """A tokenizer that notes what its library is asked for."""

    def __init__(self, library):
        self.library, self.texts, self.protos = library, 0, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode(self, text, **how):
        self.texts += 1
        self.protos += how.get("return_type") == "proto"
        return self.library.encode(text, **how)

    def encode_batch(self, texts, **how):
        self.texts += len(texts)
        return self.library.encode_batch(texts, **how)


def test_new_words_go_to_both_libraries_together():
    own = Aligner(A, B)
    words = [f" x{k}y" for k in range(3000)] + [f" é{k}." for k in range(3000)] + ["\n", " ", " tail\t"]
    alone = [own.align([w]) for w in words]
    own.a, own.b = Asked(own.a), Asked(own.b)
    ok, counts, groups, pairs = own.align(words)
    assert own.a.texts <= 10 and own.b.texts <= 10 and not own.b.protos
    assert ok.all() and groups == [x[2][0] for x in alone] and counts.tolist() == [x[1][0].tolist() for x in alone]
    assert pairs.tolist() == [p for x in alone for p in x[3].tolist()]


def test_words_that_a_library_joins_go_alone():
    class Joins(Asked):
        def encode(self, text, **how):
            return super().encode(text.replace(" b", "b"), **how)

    words = [" a1", " b1", " c1"]
    own = Aligner(A, B)
    want = own.a_spans(words)
    own.a = Joins(own.a)
    got = own.a_spans(words)
    assert got[0] == want[0] and got[1].tolist() == want[1].tolist() and got[2].tolist() == want[2].tolist()
