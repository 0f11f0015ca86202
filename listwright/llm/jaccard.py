"""N-gram Jaccard join with rare-first prefix filtering (operator 7).

A document is the set of its word n-grams, as 64-bit hashes. Documents with the
same set are one class, so exact copies cost nothing further. The join runs on
classes:

1. Texts are read once. All n-grams are dealt by their hash and counted, so every document learns
   which of its n-grams occur elsewhere, and how often. Frequency and hash order
   the n-grams; sets that reach the similarity share one among the first
   ``n - ceil(t n) + 1`` of either. N-grams that nobody else has come first and
   join with nothing, so most documents have no prefix left to join on. An n-gram
   that many documents of a batch hold is sent once, with its count.
2. Classes are joined on the prefix n-grams. Members of one n-gram are linked in
   a chain, not in pairs, and a task links its own before the shuffle. The parts
   that hang together are the candidate groups; no pair outside one can link.
3. The text of one document of each class goes to its candidate group once. There
   the pairs are proposed again by prefixes (ordered by frequency in the group)
   and pass the length, positional and suffix filters; a pair is compared in full
   once, unless its classes are connected already.
4. A group too large for a task is split into parts, each with the same first
   class, which joins near copies to a few components in time that grows with the
   group. Classes outside the largest of them are then joined with the others on
   their prefix n-grams: first one class of each component with the first class of
   the n-gram, then all that are still apart. Pairs pass the length and positional
   filters within the join, and each is verified once, in blocks of bounded size.

Defined cases: null, empty and blank texts have an empty set and are linked with
nothing; texts of fewer words than ``n`` have one n-gram, all their words;
rows that share a doc_id are documents of their own, with equal texts or not; a null doc_id joins
components but names none (a component without any doc_id has a null id); other columns are not read; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import SQL, beside, materialize, query, table
from listwright.llm.components import components

N, PERCENT = 5, 80
BUCKET_NGRAMS = 250_000  # n-grams that are counted together
BATCH_NGRAMS = 1_000_000  # n-grams that a task deals out at a time
BATCH_DOCS = 60_000
PART_NGRAMS = 400_000  # n-grams of the classes that one task compares
PIECE_CHARS = 1_000_000
WORDS_KEPT = 500_000

MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def ngram_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """Sorted different hashes of each text's n-grams."""
    some: list[bytes] = []
    sizes: list[int] = []
    chars = 0
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        some += words
        sizes.append(len(words))
        chars += len(text)
        if chars < PIECE_CHARS and k + 1 < len(texts):
            continue
        if len(HASHES) > WORDS_KEPT:
            HASHES.clear()
        w = np.fromiter(map(HASHES.__getitem__, some), np.uint64, len(some))
        whole = fold([w[j : len(w) - n + 1 + j] for j in range(n)], n) if len(w) >= n else w[:0]
        at = 0
        for size in sizes:
            if size >= n:
                yield np.unique(whole[at : at + size - n + 1])
            else:
                yield fold([w[at + j : at + j + 1] for j in range(size)], size) if size else w[:0]
            at += size
        some, sizes, chars = [], [], 0


def fold(words: list[np.ndarray], n: int) -> np.ndarray:
    """One hash for the words that stand at the same place of each array."""
    out = np.full(len(words[0]), n + 1, np.uint64) * MIX
    for w in words:
        out = (out ^ w) * MIX
        out ^= out >> SHIFT
    return out


def needed(size: int | np.ndarray, percent: int):
    """Least n-grams that a set of this size shares with one that it links to."""
    return -(-percent * size // 100)


def sign(ngrams: np.ndarray) -> tuple[int, int]:
    """Two numbers that stand for a set."""
    a, b = np.frombuffer(blake2b(ngrams.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def source(docs: DataFrame) -> DataFrame:
    """``d`` (doc_id), ``known``, ``h`` and ``text``; ``d`` and ``h`` together find a document again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))


DEALT = "bucket long, batch long, payload binary, many binary, docs binary"


def dealt(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """The n-grams by bucket (their first ``bits`` bits): the next 32 bits of each, and the document's number in its batch.

    Of equal sets in a batch one is enough. ``many`` has the n-grams that several
    sets of the batch hold, each once with their number. A row with a negative
    bucket tells the batch's classes, the sizes of their sets, who holds those, and
    ``known, d, h, n, a, b`` of all its documents.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        batch_id = TaskContext.get().partitionId() << 32
        some: dict[int, np.ndarray] = {}
        read: list[tuple] = []
        held = 0

        def close() -> pd.DataFrame:
            sizes = np.array([len(x) for x in some.values()], np.int64)
            grams = np.concatenate([np.zeros(0, np.uint64), *some.values()])
            owner = np.repeat(np.arange(len(sizes)), sizes).astype("<u2")
            order = np.argsort(grams, kind="stable")
            grams, owner = (grams[order] >> np.uint64(32 - bits)).astype(np.int64), owner[order]
            starts = np.flatnonzero(np.diff(grams, prepend=-1))
            counts = np.diff(np.append(starts, len(grams)))
            different, alone = grams[starts], counts == 1
            bucket, rest = different >> 32, (different & 0xFFFFFFFF).astype("<u4")
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for x, y in zip(first, np.append(first, len(bucket))[1:], strict=True):
                single, several = np.flatnonzero(alone[x:y]) + x, np.flatnonzero(~alone[x:y]) + x
                rows.append((
                    int(bucket[x]), batch_id, rest[single].tobytes() + owner[starts[single]].tobytes(),
                    rest[several].tobytes() + counts[several].astype("<u4").tobytes(), None,
                ))
            own = np.fromiter(some, np.int64, len(some)).tobytes() + sizes.tobytes()
            holders = different[~alone].tobytes() + counts[~alone].tobytes() + owner[np.repeat(~alone, counts)].tobytes()
            rows.append((-1 - batch_id % 1009, batch_id, own, np.int64((~alone).sum()).tobytes() + holders, np.array(read, np.int64).tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "batch", "payload", "many", "docs"])

        for batch in batches:
            known, d, h = (batch[x].tolist() for x in ("known", "d", "h"))
            for k, ngrams in enumerate(ngram_sets(batch["text"].tolist(), n)):
                name, other = sign(ngrams)
                read.append((known[k], d[k], h[k], len(ngrams), name, other))
                if len(ngrams) and name not in some:
                    some[name] = ngrams
                    held += len(ngrams)
                if held >= BATCH_NGRAMS or len(some) >= BATCH_DOCS or len(read) >= 4 * BATCH_DOCS:
                    yield close()
                    batch_id, held = batch_id + 1, 0
                    some.clear()
                    read.clear()
        if read:
            yield close()

    return source(docs).mapInPandas(deal, DEALT)


def shared(rows: DataFrame) -> DataFrame:
    """Of the dealt n-grams those that occur more than once, with their frequency, by batch."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:
            return group
        ones = [len(x) // 6 for x in group["payload"]]
        several = [len(x) // 8 for x in group["many"]]
        rest = np.concatenate([
            *(np.frombuffer(x, "<u4", k) for x, k in zip(group["payload"], ones, strict=True)),
            *(np.frombuffer(x, "<u4", k) for x, k in zip(group["many"], several, strict=True)),
        ])
        owner = np.concatenate([np.frombuffer(x, "<u2", k, 4 * k) for x, k in zip(group["payload"], ones, strict=True)])
        weight = np.concatenate([np.ones(sum(ones)), *(np.frombuffer(x, "<u4", k, 4 * k) for x, k in zip(group["many"], several, strict=True))])
        _, place = np.unique(rest, return_inverse=True)
        often = np.minimum(np.bincount(place, weight)[place], 65535).astype("<u2")
        out, at, behind = [], 0, sum(ones)
        for batch, k, m in zip(group["batch"], ones, several, strict=True):
            some = np.flatnonzero(often[at : at + k] > 1) + at
            if len(some) or m:
                found = rest[some].tobytes() + owner[some].tobytes() + often[some].tobytes()
                out.append((group["bucket"].iloc[0], batch, found, rest[behind : behind + m].tobytes() + often[behind : behind + m].tobytes(), None))
            at, behind = at + k, behind + m
        return pd.DataFrame(out, columns=["bucket", "batch", "payload", "many", "docs"])

    return rows.groupBy("bucket").applyInPandas(count, DEALT)


def prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """What one pass over the texts yields, written to the shared folder.

    ``kind`` 0: ``gram, node, pos, size, head``; a class (``node``, the first
    number of its sign) holds the n-gram at this place of its order, and ``head``
    marks one class for each n-gram of a batch. 1: ``node`` and ``other`` follow
    one another at an n-gram within a batch. 2: ``known, d, h, n, a, b`` of a document.
    """
    total = (source(docs).agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    bits = min(28, int(total // BUCKET_NGRAMS).bit_length())

    def read(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["bucket"] < 0].iloc[0]
        nodes, sizes = np.frombuffer(own["payload"], np.int64).reshape(2, -1)
        k = int(np.frombuffer(own["many"], np.int64, 1)[0])
        many, held = np.frombuffer(own["many"], np.int64, 2 * k, 8).reshape(2, -1)
        some = group[group["bucket"] >= 0]
        counts = [len(x) // 8 for x in some["payload"]]
        parts = list(zip(some["payload"], counts, strict=True))
        times = np.zeros(k, np.int64)
        for x, b in zip(some["many"], some["bucket"], strict=True):
            m = len(x) // 6
            times[np.searchsorted(many, np.frombuffer(x, "<u4", m).astype(np.int64) + (b << 32))] = np.frombuffer(x, "<u2", m, 4 * m)
        gram = np.concatenate([
            np.repeat(many, held), *(np.frombuffer(x, "<u4", k).astype(np.int64) + (b << 32) for (x, k), b in zip(parts, some["bucket"], strict=True)),
        ])
        owner = np.concatenate([
            np.frombuffer(own["many"], "<u2", offset=8 + 16 * k).astype(np.int64), *(np.frombuffer(x, "<u2", k, 4 * k).astype(np.int64) for x, k in parts),
        ])
        often = np.concatenate([np.repeat(times, held), *(np.frombuffer(x, "<u2", k, 6 * k).astype(np.int64) for x, k in parts)])
        # A set's own n-grams fill its prefix first; what is left of it goes to the rarest of the others.
        order = np.lexsort((gram, often, owner))
        gram, owner = gram[order], owner[order]
        has = np.bincount(owner, minlength=len(nodes))
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(has) - has, has) + (sizes - has)[owner]
        keep = pos < (sizes - needed(sizes, percent) + 1)[owner]
        gram, pos, node, size = gram[keep], pos[keep], nodes[owner[keep]], sizes[owner[keep]]
        order = np.lexsort((node, gram))
        gram, pos, node, size = gram[order], pos[order], node[order], size[order]
        follows = np.zeros(len(gram), bool)
        follows[1:] = gram[1:] == gram[:-1]
        at = np.flatnonzero(follows)
        at = at[node[at] != node[at - 1]]
        pairs = np.unique(np.stack([node[at - 1], node[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        read = np.frombuffer(own["docs"], np.int64).reshape(-1, 6)
        count = [len(gram), len(pairs), len(read)]
        columns = {
            "gram": (0, gram), "node": (0, node), "pos": (0, pos), "size": (0, size), "head": (0, ~follows), "one": (1, pairs[:, 0]), "other": (1, pairs[:, 1]),
            **{name: (2, read[:, k]) for k, name in enumerate(("known", "d", "h", "n", "a", "b"))},
        }
        out = {"kind": np.repeat([0, 1, 2], count)}
        for name, (kind, values) in columns.items():
            out[name] = np.zeros(sum(count), np.int64)
            out[name][out["kind"] == kind] = values
        return pd.DataFrame(out)

    names = ["gram", "node", "pos", "size", "head", "one", "other", "known", "d", "h", "n", "a", "b"]
    schema = ", ".join(["kind int", *(f"{x} long" for x in names)])
    found = shared(dealt(docs, n, bits)).groupBy("batch").applyInPandas(read, schema)
    found = found.withColumns({x: F.col(x).cast("boolean") for x in ("head", "known")})
    return materialize(found, "prefixes")


def candidate_links(entries: DataFrame) -> DataFrame:
    """``a, b``: classes that follow one another at a prefix n-gram."""
    before = F.lag("node").over(Window.partitionBy("gram").orderBy("node"))
    chained = entries.where("kind = 0 AND head").select(F.col("node").alias("a"), before.alias("b")).where("b IS NOT NULL AND a != b")
    return chained.unionAll(entries.where("kind = 1").select(F.col("one").alias("a"), F.col("other").alias("b")))


def suffix_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """At least so many elements are in one of two ordered sets only; exact up to ``most``."""
    if depth == 0 or not len(x) or not len(y) or abs(len(x) - len(y)) > most:
        return abs(len(x) - len(y))
    middle = y[len(y) // 2]
    k = int(np.searchsorted(x, middle))
    same = k < len(x) and x[k] == middle
    yl, yr, xl, xr = y[: len(y) // 2], y[len(y) // 2 + 1 :], x[:k], x[k + same :]
    least = abs(len(xl) - len(yl)) + abs(len(xr) - len(yr)) + (not same)
    if least > most:
        return least
    left = suffix_bound(xl, yl, most - abs(len(xr) - len(yr)) - (not same), depth - 1)
    if left + abs(len(xr) - len(yr)) + (not same) > most:
        return left + abs(len(xr) - len(yr)) + (not same)
    return left + suffix_bound(xr, yr, most - left - (not same), depth - 1) + (not same)


def link_sets(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that link and together connect what links connect. ``label``: sets known to be connected."""
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    values, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    ranks = rank[place]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ordered = [np.sort(ranks[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    members: dict[int, list[int]] = {}
    for k, x in enumerate(label.tolist()):
        members.setdefault(x, []).append(k)
    index: dict[int, tuple[list[int], list[int]]] = {}
    links = []
    for x in np.lexsort((np.arange(len(sets)), sizes)).tolist():
        mine, size = ordered[x], int(sizes[x])
        if not size:
            continue
        first = mine[: size - needed(size, percent) + 1].tolist()
        met = [(index[t], i) for i, t in enumerate(first) if t in index]
        if met:
            other = np.concatenate([np.array(p[0]) for p, _ in met])
            there = np.concatenate([np.array(p[1]) for p, _ in met])
            here = np.repeat([i for _, i in met], [len(p[0]) for p, _ in met])
            open_ = (label[other] != label[x]) & (100 * sizes[other] >= percent * size)
            other, there, here = other[open_], there[open_], here[open_]
            if len(other):
                # Positional filter: what is shared so far, and at most all of the shorter rest.
                y, at, shared = np.unique(other, return_inverse=True, return_counts=True)
                last_here, last_there = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
                np.maximum.at(last_here, at, here)
                np.maximum.at(last_there, at, there)
                least = -(-percent * (size + sizes[y]) // (100 + percent))
                able = shared + np.minimum(size - last_here - 1, sizes[y] - last_there - 1) >= least
                y, least, shared, last_here, last_there = y[able], least[able], shared[able], last_here[able], last_there[able]
                for k in np.argsort(-shared, kind="stable").tolist():
                    o = int(y[k])
                    if label[o] == label[x]:
                        continue
                    rest_x, rest_y = mine[last_here[k] + 1 :], ordered[o][last_there[k] + 1 :]
                    most = len(rest_x) + len(rest_y) - 2 * (int(least[k]) - int(shared[k]))
                    if suffix_bound(rest_x, rest_y, most) > most:
                        continue
                    both = int(shared[k]) + len(np.intersect1d(rest_x, rest_y, assume_unique=True))
                    if 100 * both >= percent * (size + int(sizes[o]) - both):
                        links.append((x, o))
                        keep, gone = sorted((int(label[x]), int(label[o])), key=lambda g: -len(members[g]))
                        label[members[gone]] = keep
                        members[keep] += members.pop(gone)
        for i, t in enumerate(first):
            entry = index.setdefault(t, ([], []))
            entry[0].append(x)
            entry[1].append(i)
    return links


def compare(groups: DataFrame, by: list[str], n: int, percent: int) -> DataFrame:
    """``a, b``: links between classes of each group (``class, text`` and ``label``, equal for connected ones)."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("class").sort_values("class", ignore_index=True)
        found = link_sets(list(ngram_sets(group["text"].tolist(), n)), percent, group["label"].to_numpy())
        name = group["class"].to_numpy()
        return pd.DataFrame({"a": [name[x] for x, _ in found], "b": [name[y] for _, y in found]}, dtype="int64")

    return groups.select(*by, "class", "label", "text").groupBy(*by).applyInPandas(links, "a long, b long")


def class_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, entries: DataFrame, n: int, percent: int, repeated: bool) -> DataFrame:
    """All links that connect classes (``class, a, n, d, h, known``) within their candidate groups. ``repeated``: some rows are equal in doc_id and text."""
    grouped = classes.join(candidates.withColumnRenamed("node", "a"), "a").select("component", "class", "a", "n", "known", "d", "h")
    totals = grouped.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("classes"), F.min("class").alias("hub")).where("classes > 1")
    parts = F.ceil(F.col("total") / PART_NGRAMS).cast("int")
    wanted = materialize(grouped.join(totals, "component").select("component", "class", "a", "n", "known", "d", "h", "hub", parts.alias("parts")), "wanted")
    texts = source(docs).join(beside(wanted), ["known", "d", "h"]).select("component", "class", "n", "hub", "parts", "text")
    if repeated:
        texts = texts.dropDuplicates(["class"])
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    if wanted.where("parts > 1").isEmpty():
        return materialize(compare(texts.withColumn("label", F.col("class")), ["component"], n, percent), "links")
    texts = materialize(texts.withColumn("part", own), "texts")
    every = F.when(F.col("class") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    dealt = texts.withColumn("part", F.explode(every)).withColumn("label", F.col("class"))
    links = materialize(compare(dealt, ["component", "part"], n, percent), "links")
    large = wanted.where("parts > 1").select("component", "class", F.col("a").alias("node"))
    held = large.join(entries.where("kind = 0").select("gram", "node", "pos", "size"), "node")
    held = materialize(held.drop("node").dropDuplicates(["gram", "class"]), "held")
    texts = texts.select("class", "text")
    # Components of one and the same group of copies meet at the first class of an n-gram.
    marked = labelled(large, links, "first-links")
    some = held.join(marked, "class").groupBy("gram", "label").agg(F.min(F.struct("class", "size")).alias("x"))
    hubs = some.groupBy("gram").agg(F.min("x").alias("y"))
    met = some.join(hubs, "gram").where("x.class != y.class").select(
        F.col("x.class").alias("x"), F.col("y.class").alias("y"), F.col("x.size").alias("nx"), F.col("y.size").alias("ny"),
    )
    links = links.unionAll(verify(met.where(alike(percent)).distinct(), texts, n, percent, "hub-links"))
    marked = labelled(large, links, "second-links")
    if marked.where("left").isEmpty():
        return links
    return links.unionAll(verify(apart(held.join(marked, "class"), percent), texts, n, percent, "more-links"))


def labelled(large: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``class, label, left``: the component that the links yield, and whether it is other than its group's largest."""
    known = components(links, name).select(F.col("node").alias("class"), F.col("component").alias("label"))
    labels = large.join(known, "class", "left").select("component", "class", F.coalesce("label", "class").alias("label"))
    sizes = labels.groupBy("component", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("component").agg(F.max_by("label", F.struct("k", "label")).alias("largest"))
    marked = labels.join(largest, "component").select("class", "label", (F.col("label") != F.col("largest")).alias("left"))
    return materialize(marked, f"{name}-labels")


def alike(percent: int):
    """Length filter on ``nx`` and ``ny``."""
    return 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")


def apart(held: DataFrame, percent: int) -> DataFrame:
    """``x, y, nx, ny``: pairs of different labels that share prefix n-grams and pass the length and positional filters."""

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("gram", *(F.col(c).alias(f"{d}{s}") for c, d in (("class", ""), ("size", "n"), ("pos", "p"), ("label", "l"), ("left", "o"))))

    both = side(held.where("left"), "x").join(side(held, "y"), "gram").where("lx != ly AND (NOT oy OR x < y)").where(alike(percent))
    pairs = both.groupBy("x", "y").agg(
        F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.count("*").alias("shared"), F.max("px").alias("px"), F.max("py").alias("py"),
    )
    most = F.col("shared") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1
    return pairs.where((100 + percent) * most >= percent * (F.col("nx") + F.col("ny"))).select("x", "y", "nx", "ny")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """``a, b``: the pairs that link, or are connected by others of their block.

    Blocks hold about ``PART_NGRAMS``: the partners of many classes, or a part of those of one.
    """
    pairs = materialize(pairs, f"{name}-pairs")
    weight = pairs.groupBy("x").agg((F.sum("ny") + F.first("nx")).alias("w"))
    blocks = max(1, -(-(weight.agg(F.sum("w")).first()[0] or 0) // PART_NGRAMS))
    slots = F.ceil(F.col("w") / PART_NGRAMS)
    block = [F.pmod(F.xxhash64("x"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("y"), slots).alias("slot")]
    there = pairs.join(weight, "x").select(*block, "x", "y")
    asked = there.groupBy("block", "slot", F.col("y").alias("class")).agg(F.collect_list("x").alias("partners"))
    own = there.select("block", "slot", F.col("x").alias("class"), F.expr("cast(array() as array<bigint>)").alias("partners")).distinct()

    def check(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("class", kind="stable", ignore_index=True)
        first = group.drop_duplicates("class")
        sets = dict(zip(first["class"].tolist(), ngram_sets(first["text"].tolist(), n), strict=True))
        root = {x: x for x in sets}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for y, partners in zip(group["class"].tolist(), group["partners"], strict=True):
            for x in sorted(int(p) for p in partners):
                if top(x) == top(y):
                    continue
                one, other = sets[x], sets[y]
                least = -(-percent * (len(one) + len(other)) // (100 + percent))
                most = len(one) + len(other) - 2 * least
                if suffix_bound(one, other, most) <= most and len(np.intersect1d(one, other, assume_unique=True)) >= least:
                    root[top(x)] = top(y)
                    found.append((x, y))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    rows = asked.unionAll(own).join(texts, "class")
    return materialize(rows.groupBy("block", "slot").applyInPandas(check, "a long, b long"), name)


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, h, n_shingles, component_id, component`` of each document; sets link from ``percent`` on.

    ``h`` is xxhash64 of the text, ``component`` a number of the component's own (null for an empty set).
    """
    entries = prefixes(docs, n, percent)
    rows = entries.where("kind = 2").select("known", "d", "h", "n", "a", "b")
    first = F.min(F.struct((~F.col("known")).alias("unknown"), "d", "h")).alias("first")
    classes = rows.where("n > 0").groupBy("a", "b", "n").agg(first).select(
        "a", "b", "n", (~F.col("first.unknown")).alias("known"), F.col("first.d").alias("d"), F.col("first.h").alias("h"),
    )
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    candidates = components(candidate_links(entries), "candidates")
    repeated = not rows.groupBy("known", "d", "h").count().where("count > 1").isEmpty()
    links = class_links(docs, classes, candidates, entries, n, percent, repeated)
    joined = components(links, "components").select(F.col("node").alias("class"), "component")
    named = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min(F.when(F.col("known"), F.col("d"))).alias("component_id"))
    named = named.join(smallest, "component").select("a", "b", "component", "component_id")
    own = F.when(F.col("known"), F.col("d"))
    return rows.join(named, ["a", "b"], "left").select(
        own.alias("doc_id"), "h", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"), "component",
    )


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 per cent of their four-word shingles."""
    found = jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


# All pairs that share a shingle: for small tables only, but a check of the whole result.
SQL["op7_jaccard"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
