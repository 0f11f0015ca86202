"""Near copies by SetSketch registers (operator 11).

A document is the set of its word shingles. Its sketch has ``REGISTERS``
registers; register ``i`` holds ``floor(1 - log_b min h_i)`` over the shingles,
cut to 16 bits, where ``h_i`` is exponential with rate ``RATE``. Two sketches
merge by their larger registers, and a register of two sets is equal about as
often as the sets are alike.

1. Texts become shingle sets and sketches in one pass. A shingle's points of an
   exponential process are drawn in order and dealt to the registers in an order
   of its own, so drawing ends for all shingles that lie beyond the largest
   register; a set needs some thousand points, not a hash a shingle and register.
   Documents with the same set are one class.
2. Six registers make a band. Classes that are equal in a band hang together by
   its smallest class: a link a class and band, whatever the size of the bucket.
   At the similarities asked for (0.8 and more) a pair shares one of the 42 bands
   but for 3 pairs in a million (at 0.85: in five hundred million).
3. What hangs together meets in one task: each class once, with its text. Pairs
   with a common band, possible sizes and no common label yet are estimated
   jointly: the likelihood of the larger, smaller and equal registers given both
   sizes. Those whose estimate lies less than ``SIGMAS`` standard errors below
   the similarity are verified on their full sets.
4. A group that is too large for a task is dealt out in parts, each with the same
   first class; what the parts don't link to its largest component then meets the
   parts that hold one of its bands, in blocks.

Defined cases: null, empty and blank texts have an empty set and link with
nothing; texts of fewer words than a shingle have one, all their words; rows that
share a doc_id are documents of their own; a null doc_id joins components but
names none; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import SQL, beside, materialize, query, table
from listwright.llm.components import components
from listwright.llm.jaccard import ngram_sets, sign, source

N, PERCENT = 5, 80
REGISTERS = 256  # a power of two
BASE = 1.001
RATE = 20.0
TOP = 65535
BAND = 6
BANDS = REGISTERS // BAND
SIGMAS = 5.0
PART_NGRAMS = 400_000  # shingles of the classes that one task compares
PART_CLASSES = 1_500
BATCH_NGRAMS = 1_000_000  # shingles that are sketched at a time

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
MIX3 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers from any."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


def lowest(sets: list[np.ndarray]) -> np.ndarray:
    """The least hash of each register, a row a set (infinite for an empty set).

    Point ``j`` of a shingle's process lies an exponential step of rate
    ``RATE * (REGISTERS - j)`` behind the one before and belongs to the ``j``-th
    register of the shingle's order, so each register sees an exponential of rate
    ``RATE``. A shingle is done when its point lies beyond all registers of its set.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    held = np.full((len(sets), REGISTERS), np.inf)
    if not sizes.sum():
        return held
    key = mixed(np.concatenate(sets) + MIX)
    owner = np.repeat(np.arange(len(sets)), sizes)
    first = (key & np.uint64(REGISTERS - 1)).astype(np.int64)
    step = ((key >> np.uint64(20)) | np.uint64(1)).astype(np.uint32).astype(np.int64) & (REGISTERS - 1)
    point = np.zeros(len(key))
    flat = held.reshape(-1)
    for j in range(REGISTERS):
        u = (mixed(key + np.uint64((j + 1) * int(MIX) % 2**64)) >> np.uint64(11)).astype(np.float64)
        point = point - np.log((u + 1.0) * 2.0**-53) / (RATE * (REGISTERS - j))
        np.minimum.at(flat, owner * REGISTERS + ((first + j * step) & (REGISTERS - 1)), point)
        some = np.unique(owner)
        limit = np.zeros(len(sets))
        limit[some] = held[some].max(axis=1)
        go_on = point < limit[owner]
        if not go_on.any():
            break
        key, owner, first, step, point = key[go_on], owner[go_on], first[go_on], step[go_on], point[go_on]
    return held


def registers(least: np.ndarray) -> np.ndarray:
    """The registers for least hashes: larger where the hash is smaller, 0 for an empty set."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1.0 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def sketch_sets(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set of 64-bit numbers."""
    out, at = np.zeros((len(sets), REGISTERS), np.uint16), 0
    ends = np.cumsum([len(x) for x in sets])
    while at < len(sets):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BATCH_NGRAMS, "right")))
        out[at:to] = registers(lowest(sets[at:to]))
        at = to
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def slope(j: np.ndarray, plus: np.ndarray, minus: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Derivative of the log-likelihood of similarity ``j``: of so many registers of the first set larger, smaller and equal.

    ``u`` is the first size as a share of both. The likelihood is concave, so a
    positive slope means that the best estimate is larger than ``j``.
    """
    v, c = 1.0 - u, (BASE - 1.0) / BASE

    def p(x):
        return -np.log1p(-x * c) / np.log(BASE)

    def dp(x):
        return c / ((1.0 - x * c) * np.log(BASE))

    left, right = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    rest = np.maximum(1.0 - p(left) - p(right), 1e-12)
    return -v * plus * dp(left) / p(left) - u * minus * dp(right) / p(right) + same * (v * dp(left) + u * dp(right)) / rest


def compared(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many registers of one sketch are larger than, smaller than and equal to those of others."""
    plus, same = (one > others).sum(axis=1), (one == others).sum(axis=1)
    return plus.astype(float), (REGISTERS - plus - same).astype(float), same.astype(float)


def estimate(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> float:
    """The most likely similarity of two sets, by their sketches and sizes."""
    if not n_a or not n_b:
        return 0.0
    u = np.array([n_a / (n_a + n_b)])
    counts = compared(a, b[None, :])
    low, high = 0.0, min(n_a, n_b) / max(n_a, n_b)
    for _ in range(50):
        middle = (low + high) / 2
        if slope(np.array([middle]), *counts, u)[0] > 0:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, a row a sketch."""
    x = sketches[:, : BANDS * BAND].reshape(len(sketches), BANDS, BAND).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX, x.shape[:2])
    for k in range(BAND):
        out = mixed((out ^ x[:, :, k]) * MIX + np.uint64(k))
    return out.view(np.int64)


def sketched(docs: DataFrame, n: int = N) -> DataFrame:
    """``known, d, h, n, a, b, sketch`` of each document: its id, text hash, set size, sign and registers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(ngram_sets(batch["text"].tolist(), n))
            signs = [(len(x), *sign(x)) for x in sets]
            # Of equal sets in a batch one is sketched.
            first: dict[tuple, int] = {}
            place = [first.setdefault(x, len(first)) for x in signs]
            own: list[np.ndarray] = [sets[0][:0]] * len(first)
            for x, k in zip(sets, place, strict=True):
                own[k] = x
            rows = [x.tobytes() for x in sketch_sets(own)]
            out = batch[["known", "d", "h"]].copy()
            out[["n", "a", "b"]] = np.array(signs, np.int64).reshape(-1, 3)
            out["sketch"] = [rows[k] for k in place]
            yield out

    return source(docs).mapInPandas(read, "known boolean, d long, h long, n long, a long, b long, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """``key, class``: each class under the keys of its bands."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                some = batch.iloc[at : at + 2_000]
                sketches = np.frombuffer(b"".join(some["sketch"]), np.uint16).reshape(-1, REGISTERS)
                yield pd.DataFrame({"key": band_keys(sketches).reshape(-1), "class": np.repeat(some["class"].to_numpy(), BANDS)})

    return classes.select("class", "sketch").mapInPandas(deal, "key long, class long")


def alike(sets: list[np.ndarray], percent: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets that link and together connect what links connect. ``label``: sets known to be connected."""
    label = np.unique(label, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    sketches = sketch_sets(sets)
    keys = band_keys(sketches)
    least = percent / 100
    sure = max(0.0, least - SIGMAS * np.sqrt(least * (1 - least) / REGISTERS))
    links = []
    for x in range(1, len(sets)):
        small, large = np.minimum(sizes[:x], sizes[x]), np.maximum(sizes[:x], sizes[x])
        met = np.flatnonzero((label[:x] != label[x]) & (100 * small >= percent * large) & (small > 0))
        met = met[(keys[met] == keys[x]).any(axis=1)]
        if not len(met):
            continue
        plus, minus, same = compared(sketches[x], sketches[met])
        u = sizes[x] / (sizes[x] + sizes[met])
        able = slope(np.full(len(met), sure), plus, minus, same, u) > 0
        met, same = met[able], same[able]
        for o in met[np.argsort(-same, kind="stable")].tolist():
            if label[o] == label[x]:
                continue
            both = len(np.intersect1d(sets[x], sets[o], assume_unique=True))
            if 100 * both >= percent * (int(sizes[x]) + int(sizes[o]) - both):
                links.append((x, o))
                label[label == label[x]] = label[o]
    return links


def verified(groups: DataFrame, by: list[str], n: int, percent: int) -> DataFrame:
    """``a, b``: links between the classes of each group (``class, text`` and ``label``, equal for connected ones)."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("class").sort_values("class", ignore_index=True)
        found = alike(list(ngram_sets(group["text"].tolist(), n)), percent, group["label"].to_numpy())
        name = group["class"].to_numpy()
        return pd.DataFrame({"a": [name[x] for x, _ in found], "b": [name[y] for _, y in found]}, dtype="int64")

    return groups.select(*by, "class", "label", "text").groupBy(*by).applyInPandas(links, "a long, b long")


def parts_of(total: str, count: str):
    return F.ceil(F.greatest(F.col(total) / PART_NGRAMS, F.col(count) / PART_CLASSES)).cast("int")


def class_links(docs: DataFrame, classes: DataFrame, keys: DataFrame, groups: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that connect all classes that link, found within ``groups`` (``class, component``)."""
    grouped = classes.join(groups, "class").select("component", "class", "n", "known", "d", "h")
    totals = grouped.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("count"), F.min("class").alias("hub"))
    totals = totals.select("component", "hub", parts_of("total", "count").alias("parts"))
    wanted = materialize(grouped.join(totals, "component"), "wanted")
    texts = source(docs).join(beside(wanted), ["known", "d", "h"]).select("component", "class", "n", "hub", "parts", "text")
    if wanted.where("parts > 1").isEmpty():
        return materialize(verified(texts.withColumn("label", F.col("class")), ["component"], n, percent), "links")
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    texts = materialize(texts.withColumn("part", own), "texts")
    every = F.when(F.col("class") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    dealt = texts.withColumn("part", F.explode(every)).withColumn("label", F.col("class"))
    links = materialize(verified(dealt, ["component", "part"], n, percent), "links")
    # Beyond the largest component of a large group: back to the parts that hold an equal band of another label.
    large = wanted.where("parts > 1").select("component", "class", "n", own.alias("part"))
    labels = large.join(components(links, "first-links").select(F.col("node").alias("class"), F.col("component").alias("label")), "class", "left")
    labels = materialize(labels.withColumn("label", F.coalesce("label", "class")), "labels")
    sizes = labels.groupBy("component", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("component").agg(F.max_by("label", F.struct("k", "label")).alias("largest"))
    marked = labels.join(largest, "component").withColumn("left", F.col("label") != F.col("largest")).drop("largest")
    rest = marked.where("left").groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("count"))
    rest = rest.select("component", parts_of("total", "count").alias("blocks"))
    marked = materialize(marked.join(rest, "component").withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int")), "marked")
    if marked.isEmpty():
        return links
    held = keys.join(marked, "class").select("key", "component", "part", "label", "left", "block")
    there = held.groupBy("key", "component", "part").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    asked = held.where("left").groupBy("key", "component", "block").agg(F.min("label").alias("one"), F.max("label").alias("other"))
    meet = asked.join(there, ["key", "component"]).where("low != high OR one != other OR low != one").select("component", "block", "part").distinct()
    meet = materialize(meet, "meet")
    again = texts.select("component", "class", "text").join(marked, ["component", "class"])
    kept = ["component", "part", "block", "class", "label", "text"]
    as_part = again.drop("block").join(meet, ["component", "part"]).select(*kept)
    as_rest = again.where("left").drop("part").join(meet, ["component", "block"]).select(*kept)
    more = verified(as_part.unionAll(as_rest), ["component", "part", "block"], n, percent)
    return links.unionAll(materialize(more, "more-links"))


def near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, h, n_shingles, component_id, component`` of each document; sets link from ``percent`` on.

    ``h`` is xxhash64 of the text, ``component`` a number of the component's own (null for an empty set).
    """
    rows = materialize(sketched(docs, n), "sketched")
    first = F.min(F.struct((~F.col("known")).alias("unknown"), "d", "h")).alias("first")
    classes = rows.where("n > 0").groupBy("a", "b", "n").agg(first, F.first("sketch").alias("sketch")).select(
        "a", "b", "n", (~F.col("first.unknown")).alias("known"), F.col("first.d").alias("d"), F.col("first.h").alias("h"), "sketch",
    )
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    keys = banded(classes)
    hubs = keys.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("top")).where("hub != top").select("key", "hub")
    keys = materialize(keys.join(hubs, "key"), "keys")
    stars = keys.where("class != hub").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    groups = components(stars, "groups").withColumnRenamed("node", "class")
    links = class_links(docs, classes, keys, groups, n, percent)
    joined = components(links, "components").withColumnRenamed("node", "class")
    named = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min(F.when(F.col("known"), F.col("d"))).alias("component_id"))
    named = named.join(smallest, "component").select("a", "b", "component", "component_id")
    own = F.when(F.col("known"), F.col("d"))
    return rows.select("known", "d", "h", "n", "a", "b").join(named, ["a", "b"], "left").select(
        own.alias("doc_id"), "h", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"), "component",
    )


@query
def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 per cent of their three-word shingles; the first of each is kept."""
    found = near_copies(table(spark, sf_dir, "documents"), n=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


# All pairs that share a shingle: for small tables only, but a check of the whole result.
SQL["op11_setsketch"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
    FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
