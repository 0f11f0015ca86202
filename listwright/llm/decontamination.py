"""Benchmark decontamination by BM25 over an index of the test items (operator 4).

The test items are indexed, in parts of at most ``PART_WORDS`` words; the
training passages are the queries. A passage is a window of two chunks of
``PART_WORDS`` words, one chunk apart, so every part that a text holds lies
within one passage. The BM25 weight of a term in a part is divided by the score
that the part gives itself, so one threshold serves all parts.

All parts at or above the threshold are retrieved with block-max WAND, many
passages at a time. Terms whose upper bounds together stay below a
quarter of the threshold can't decide and are left out at first. Of the rest, the upper bounds
within blocks of ``BLOCK_PARTS`` parts are added for each passage, and a block
that can't reach what is missing is skipped. Parts of the blocks that are left
are scored in full. Both bounds are safe: nothing above the threshold is lost.

A retrieved item counts only if the text there holds enough of its question and
of its answer, measured by shares of their runs of ``GRAM`` words. The answer is the
last sentence of an item, or its last third if it has but one; neither takes
less than a quarter.

Words are cut at white space and signs of any script. Scripts without blanks
between words give the overlapping pairs of neighbouring characters as words.

Term frequencies, the number of parts and their mean length are counted once by Spark over
all items, so no weight depends on how the items are dealt to indexes. Tasks
build an index for each shard of at most ``INDEX_CHARS`` characters (or one item) and store it;
the driver passes them on one at a time. A benchmark of several shards takes a pass over the texts for each.

Defined cases: null and empty texts match nothing; null, empty and wordless
items match nothing; items of fewer than ``FEWEST_WORDS`` words count where their whole word sequence
stands, those of fewer than ``GRAM`` words only where a text holds nothing else (question and
answer shares are 1 then); rows equal in item_id and text are one item, other texts under the same item_id
match one by one; rows that share a doc_id are searched one by one; empty tables
give empty results; other columns are not read (``decontaminate`` keeps them).
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import materialize, query, table

K1, B = 1.2, 0.75
THRESHOLD = 0.45  # of the score that a part gives itself
OVERLAP = 0.5  # of the question's and of the answer's runs of words
GRAM = 3
PART_WORDS = 96
BLOCK_PARTS = 8
UNDECIDING = 0.25
FEWEST_WORDS = 8
INDEX_CHARS = 4_000_000
PIECE_CHARS = 1_000_000
CELLS = 4_000_000  # passages times blocks looked at together
FOUND = [("long", "item_id"), ("double", "score"), ("double", "question"), ("double", "answer")]

SPLIT = bytes(x if chr(x).isalnum() or x >= 128 else 32 for x in range(256))
# Thai, Lao, Burmese, Khmer, kana and Han characters
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af]+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])")


class Signs(dict):
    """What becomes of each character beyond ASCII: signs are blanks, invisible marks vanish."""

    def __missing__(self, code: int) -> int | str:
        kind = unicodedata.category(chr(code))
        self[code] = out = code if code < 128 or kind[0] in "LMN" else "" if kind == "Cf" else " "
        return out


SIGNS = Signs()


def pairs(run: re.Match) -> str:
    chars = run[0]
    return f" {' '.join(map(''.join, zip(chars, chars[1:], strict=False))) or chars} "


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation; pairs of characters where a script has no blanks."""
    text = (text or "").lower()
    if not text.isascii():
        text = UNSPACED.sub(pairs, text.translate(SIGNS))
    return text.encode().translate(SPLIT).split()


def grams(words: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def parts_of(words: list[bytes]) -> list[list[bytes]]:
    """The parts of an item; a rest of a few words is left to the question and answer check."""
    cut = [words[a : a + PART_WORDS] for a in range(0, len(words), PART_WORDS)]
    return [x for k, x in enumerate(cut) if not k or len(x) >= FEWEST_WORDS]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [x for x in (words_of(y) for y in SENTENCE_END.split(text)) if x]
    words = [w for x in sentences for w in x]
    cut = len(words) - len(sentences[-1]) if len(sentences) > 1 else 2 * len(words) // 3
    least = max(GRAM, len(words) // 4)
    cut = min(max(cut, least), len(words) - least)
    return words[:cut], words[cut:]


@dataclass
class Index:
    """Postings by term and block, and the largest weight of each term within each block."""

    items: list[tuple[int, list[set], list[bytes], int]]  # item_id, runs of words of question and answer, all words if few, their number
    terms: dict[bytes, int]
    owner: np.ndarray  # item of each part
    essential: np.ndarray  # by term
    slack: float  # what the other terms can add
    block_start: np.ndarray  # by term, into the next two
    block: np.ndarray
    block_max: np.ndarray
    posting_start: np.ndarray  # by term and block, into the next two
    posting: np.ndarray  # parts
    weight: np.ndarray
    blocks: int

    def passages(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First passage of each text, and for each word its chunk among all passages."""
        sizes = np.diff(bounds)
        chunks = np.maximum(1, -(-sizes // PART_WORDS))
        first = np.concatenate([[0], np.cumsum(chunks)])
        place = np.arange(len(ids)) - np.repeat(bounds[:-1], sizes)
        return first, np.repeat(first[:-1], sizes) + place // PART_WORDS

    def retrieve(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First passage of each text, and ``(passage, part, score)`` of all parts at or above the threshold."""
        first, chunk = self.passages(ids, bounds)
        keep = ids >= 0
        term, at = ids[keep], chunk[keep]
        before = at > np.repeat(first[:-1], np.diff(bounds))[keep]
        n_terms = len(self.essential)
        key = np.unique(np.concatenate([at * n_terms + term, (at[before] - 1) * n_terms + term[before]]))
        passage, term = key // n_terms, key % n_terms
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, CELLS // max(1, self.blocks))
        for a in range(0, int(first[-1]), step):
            lo, hi = np.searchsorted(passage, [a, a + step])
            p, t = passage[lo:hi] - a, term[lo:hi]
            deciding = self.essential[t]
            cell, entry = self._blocks_of(p[deciding], t[deciding])
            if not len(cell):
                continue
            bound = np.bincount(cell, weights=self.block_max[entry], minlength=step * self.blocks)
            left = np.flatnonzero(bound >= THRESHOLD - self.slack - 1e-9)
            if not len(left):
                continue
            number = np.full(len(bound), -1)
            number[left] = np.arange(len(left))
            some = np.zeros(step, bool)
            some[left // self.blocks] = True
            some = some[p]
            cell, entry = self._blocks_of(p[some], t[some])
            inside = number[cell] >= 0
            which, entry = number[cell[inside]], entry[inside]
            row, posting = spread(self.posting_start, entry)
            score = np.bincount(which[row] * BLOCK_PARTS + self.posting[posting] % BLOCK_PARTS, weights=self.weight[posting])
            hit = np.flatnonzero(score >= THRESHOLD - 1e-9)
            cell = left[hit // BLOCK_PARTS]
            found.append((cell // self.blocks + a, cell % self.blocks * BLOCK_PARTS + hit % BLOCK_PARTS, score[hit]))
        return first, *(np.concatenate(x) for x in zip(*found, strict=True))

    def _blocks_of(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (passage times blocks) and entries of the terms' blocks."""
        row, entry = spread(self.block_start, term)
        return passage[row] * self.blocks + self.block[entry], entry

    def matches(self, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
        """``(text, item_id, score, question, answer)`` of the items that texts hold."""
        lists = [words_of(x) for x in texts]
        get = self.terms.get
        ids = np.array([get(w, -1) for x in lists for w in x], np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
        if not len(ids) or not len(self.owner):
            return []
        first, passages, parts, scores = self.retrieve(ids, bounds)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p, part, score in zip(passages.tolist(), parts.tolist(), scores.tolist(), strict=True):
            k = int(np.searchsorted(first, p, "right")) - 1
            start = (p - int(first[k])) * PART_WORDS
            item = self.owner[part]
            item_id, runs, few, size = self.items[item]
            around = lists[k][max(0, start - size) : start + 2 * PART_WORDS + size]
            if few:
                held = tuple(few) in grams(around, size) if size >= GRAM else few == lists[k]
                q = a = float(held)
            else:
                there = grams(around)
                q, a = (len(x & there) / len(x) if x else 1.0 for x in runs)
            if q >= OVERLAP and a >= OVERLAP:
                best[k, item] = max(best.get((k, item), (0.0, 0.0, 0.0)), (score, q, a))
        return [(k, self.items[item][0], *found) for (k, item), found in sorted(best.items())]


def spread(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges ``starts[k]`` to ``starts[k + 1]``, and which of ``at`` each belongs to."""
    n = starts[at + 1] - starts[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    row = np.repeat(np.arange(len(at)), n)
    return row, np.arange(total) + (starts[at] - (ends - n))[row]


def build_index(items: list[tuple[int, str]], frequency: dict[bytes, int], n_parts: int, mean: float) -> Index:
    """The index of some items by the statistics of all: parts that hold a term, number of parts, their mean length."""
    kept, parts, owner = [], [], []
    for item_id, text in items:
        words = words_of(text)
        if not words:
            continue
        for part in parts_of(words):
            parts.append(Counter(part))
            owner.append(len(kept))
        if len(words) < FEWEST_WORDS:
            kept.append((item_id, [], words, len(words)))
        else:
            kept.append((item_id, [grams(x) for x in question_and_answer(text)], [], len(words)))
    terms = {t: k for k, t in enumerate(sorted({t for x in parts for t in x}))}
    n = len(parts)
    postings = []
    for k, part in enumerate(parts):
        size = sum(part.values())
        weight = {
            terms[t]: math.log(1 + (n_parts - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            for t, tf in part.items()
        }
        total = sum(weight.values())
        postings += [(t, k // BLOCK_PARTS, k, w / total) for t, w in weight.items()]
    postings.sort()
    term, block, part, weight = (np.array(x) for x in zip(*postings, strict=True)) if postings else (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
    top = np.zeros(len(terms))
    np.maximum.at(top, term, weight)
    rising = np.argsort(top, kind="stable")
    left_out = rising[np.cumsum(top[rising]) <= THRESHOLD * UNDECIDING]
    essential = np.ones(len(terms), bool)
    essential[left_out] = False
    return Index(
        kept, terms, np.array(owner, np.int64), essential, float(top[left_out].sum()),
        np.searchsorted(term[new], np.arange(len(terms) + 1)), block[new], np.maximum.reduceat(weight, new) if len(new) else weight,
        np.append(new, len(term)), part, weight, -(-n // BLOCK_PARTS),
    )


def sharded(benchmark: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``shard, item_id, text`` of the different items, and the number of shards: none of several items is longer than ``limit``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialize(items.where("text IS NOT NULL").distinct(), "test-items")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // limit))
    while True:
        out = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("shard"), "item_id", "text")
        sizes = out.groupBy("shard").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("items"))
        if n == 1 or sizes.where(f"chars > {limit} AND items > 1").isEmpty():
            return out, n
        n *= 2


def statistics(items: DataFrame) -> DataFrame:
    """``shard, term, frequency, parts, words``: each term of each shard with the parts of all shards that hold it; a row without a term has the sums of all parts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            parts = words = 0
            for shard, text in zip(batch["shard"], batch["text"], strict=True):
                for part in parts_of(words_of(text)):
                    found.update((shard, t) for t in set(part))
                    parts, words = parts + 1, words + len(part)
            rows = [(s, t, n, 0, 0) for (s, t), n in found.items()]
            yield pd.DataFrame([*rows, (-1, None, 0, parts, words)], columns=["shard", "term", "frequency", "parts", "words"])

    counted = items.mapInPandas(count, "shard long, term binary, frequency long, parts long, words long")
    counted = counted.groupBy("shard", "term").agg(*(F.sum(x).alias(x) for x in ("frequency", "parts", "words")))
    # a row for each shard at most stands behind a term
    return counted.withColumn("frequency", F.sum("frequency").over(Window.partitionBy("term")))


def stored_indexes(benchmark: DataFrame, limit: int = INDEX_CHARS) -> tuple[DataFrame, int]:
    """``shard, image``: an index for each shard of the test items, built in tasks; and the number of shards."""
    items, n = sharded(benchmark, limit)
    known = materialize(statistics(items), "test-terms")
    sums = known.where("term IS NULL").first()
    n_parts, mean = (sums["parts"], sums["words"] / max(1, sums["parts"])) if sums else (0, 0.0)

    def build(rows: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"shard": [], "image": []})
        named = [(None if pd.isna(x) else int(x), text) for x, text in zip(rows["item_id"], rows["text"], strict=True)]
        named.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        frequency = dict(zip(terms["term"], terms["frequency"].tolist(), strict=True))
        index = build_index(named, frequency, n_parts, mean)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "image": [pickle.dumps(index, 5)]})

    terms = known.where("term IS NOT NULL").select("shard", "term", "frequency")
    items = items.withColumn("item_id", F.col("item_id").cast("string"))  # pandas would make numbers with gaps inexact
    built = items.groupBy("shard").cogroup(terms.groupBy("shard")).applyInPandas(build, "shard long, image binary")
    return materialize(built, "test-indexes"), n


def indexes(benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """The indexes one after the other, each sent to all workers; and whether there is only one."""
    stored, n = stored_indexes(benchmark)
    for k in range(n):
        row = stored.where(F.col("shard") == k).select("image").first()
        if row:
            index = benchmark.sparkSession.sparkContext.broadcast(pickle.loads(row["image"]))
            yield index, n == 1
            if n > 1:
                index.unpersist()


def matcher(index: Broadcast, text: str = "text") -> Column:
    """The items that a text holds, as an array of structs."""

    @F.pandas_udf(f"array<struct<{','.join(f'{y}:{x}' for x, y in FOUND)}>>")
    def match(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        out: list[list[dict]] = [[] for _ in values]
        a, size = 0, 0
        for k, value in enumerate(values):
            size += len(value)
            if size >= PIECE_CHARS or k + 1 == len(values):
                for at, item_id, score, question, answer in index.value.matches(values[a : k + 1]):
                    out[a + at].append({"item_id": item_id, "score": score, "question": question, "answer": answer})
                a, size = k + 1, 0
        return pd.Series(out)

    return match(F.coalesce(F.col(text).cast("string"), F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, question, answer`` for each document and each test item that it holds."""
    out = docs.select("doc_id").limit(0).selectExpr("doc_id", *(f"CAST(NULL AS {x}) AS {y}" for x, y in FOUND))
    for index, only in indexes(benchmark):
        found = docs.select("doc_id", F.explode(matcher(index)).alias("m")).select("doc_id", "m.*")
        if only:
            return found
        out = out.unionAll(materialize(found, "test-hits"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    out = docs
    for index, only in indexes(benchmark):
        out = out.where(F.size(matcher(index)) == 0)
        if not only:
            out = materialize(out, "without-tests")
    return out


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items, with the items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
