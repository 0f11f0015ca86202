"""Packing documents into sequences of a fixed length by repeated patterns (operator 6).

Only longer documents are cut. Pieces of the full length are sequences of their
own. For the others, lengths are counted into bins; patterns of one to three
bins that fill a sequence are enumerated; non-negative least squares gives how
often each pattern should occur, and the counts are rounded down and cut to
what there is. What is left is packed best fit, longest first, on the counts
of exact lengths. All of this works on one histogram of at most ``size``
numbers, whatever the corpus. The pieces themselves stay distributed: each
gets its rank among pieces of its length, and the plan turns (length, rank)
into a sequence.

Defined cases: a null or empty text is a document of the end id alone; rows that
share a doc_id, even whole repeated rows, are separate documents; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import materialize, query, table

BINS = 256


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 that makes ``|a x - b|`` least (active sets)."""
    rows, columns = a.shape
    x, active = np.zeros(columns), np.zeros(columns, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(steps):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= tolerance * scale or active.sum() >= rows:
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            ratio = x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)
            step = float(ratio.min())
            x[at] += step * (s - x[at])
            gone = at[low & (x[at] <= tolerance * scale)]
            if not len(gone):
                gone = at[low][np.argmin(ratio)][None]
            x[gone] = 0
            active[gone] = False
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """One to three bins (numbered from 1) that add up to all of ``bins``, largest first."""
    out = [(bins,)]
    for a in range(bins - 1, 0, -1):
        for b in range(min(a, bins - a), 0, -1):
            c = bins - a - b
            if c == 0:
                out.append((a, b))
            elif c <= b:
                out.append((a, b, c))
    return out


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on counts: ``[(sequences alike, [(length, how many in each)])]``.

    Open sequences with the same room and content are handled as one lot.
    """
    lots: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, items: list[tuple[int, int]]) -> None:
        if room not in lots:
            lots[room] = []
            insort(rooms, room)
        lots[room].append((n, items))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, n, items = size, 0, []
            else:
                room = rooms[k]
                n, items = lots[room].pop()
                if not lots[room]:
                    del lots[room], rooms[k]
            each = min(left, room // length)
            whole = left // each if not n else min(n, left // each)
            put(room - each * length, whole, [*items, (length, each)])
            left -= whole * each
            if n > whole:
                put(room, n - whole, items)
    return [x for room in lots.values() for x in room]


class Plan:
    """Where the pieces of each length go, by their rank among them."""

    def __init__(self, size: int):
        self.size, self.sequences = size, 0
        self.spans: dict[int, list[tuple[int, int, int]]] = {}  # length: (first rank, first sequence, pieces in each)
        self.used: dict[int, int] = {}

    def add(self, n: int, items: list[tuple[int, int]]) -> None:
        for length, each in items:
            first = self.used.get(length, 0)
            self.spans.setdefault(length, []).append((first, self.sequences, each))
            self.used[length] = first + n * each
        self.sequences += n

    def table(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in self.spans.items()}


def plan_packing(histogram: dict[int, int], size: int, bins: int = BINS) -> Plan:
    """Sequences for a histogram of lengths: patterns first, then what they leave."""
    bins = min(bins, size)
    left = {k: int(v) for k, v in histogram.items() if v}
    plan = Plan(size)
    if left.get(size):
        plan.add(left.pop(size), [(size, 1)])
    width = -(-size // bins)
    counts = np.zeros(bins)
    members: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        u = -(-length // width)
        counts[u - 1] += left[length]
        members.setdefault(u, []).append(length)
    if left:
        shapes = [x for x in patterns(size // width) if all(counts[u - 1] for u in x)]
        if shapes:
            a = np.zeros((bins, len(shapes)))
            for k, x in enumerate(shapes):
                for u in x:
                    a[u - 1, k] += 1
            fit = np.floor(non_negative_least_squares(a, counts) + 1e-6).astype(np.int64)
            for k in np.argsort(-fit, kind="stable"):
                _repeat(plan, shapes[k], int(fit[k]), members, left)
    for n, items in best_fit({k: v for k, v in left.items() if v}, size):
        plan.add(n, items)
    return plan


def _repeat(plan: Plan, shape: tuple[int, ...], times: int, members: dict[int, list[int]], left: dict[int, int]) -> None:
    """Use a pattern so often: the longest lengths of its bins, and in the end the longest that fits the room."""
    there = sorted(x for x, n in left.items() if n)
    while times > 0:
        take: dict[int, int] = {}
        room = plan.size
        for k, u in enumerate(shape):
            if k + 1 < len(shape):
                found = next((x for x in members[u] if left[x] > take.get(x, 0)), None)
            else:
                at = bisect_left(there, room + 1) - 1
                while at >= 0 and left[there[at]] <= take.get(there[at], 0):
                    at -= 1
                found = there[at] if at >= 0 else None
            if found is None or found > room:
                return
            take[found] = take.get(found, 0) + 1
            room -= found
        n = min(times, *(left[x] // m for x, m in take.items()))
        plan.add(n, list(take.items()))
        for x, m in take.items():
            left[x] -= n * m
        there = [x for x in there if left[x]] if any(not left[x] for x in take) else there
        times -= n


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """Encoded documents in pieces: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``), ``part`` and ``rank``.

    ``part`` is the task that made the row and ``rank`` counts the task's pieces
    of that length, so a piece's rank in the corpus needs no sort of all pieces.
    Both are fixed once the table is written.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<long>" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from listwright.llm.encoding import encoder

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            ids, sizes = enc.encode(batch["text"].tolist())
            out, at = [], 0
            for known, doc_id, n in zip(batch["known"], batch["doc_id"], sizes.tolist(), strict=True):
                whole = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for k, start in enumerate(range(0, len(whole), size)):
                    one = whole[start : start + size]
                    row = (doc_id if known else None, k, start, len(one), zlib.crc32(one.tobytes()), part, seen[len(one)])
                    out.append((*row, one.astype(np.int64)) if with_ids else row)
                    seen[len(one)] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * with_ids
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInPandas(cut, fields)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, bins: int = BINS, with_ids: bool = False
) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``.

    Texts are read once and never shuffled; the pieces are written to the
    shared folder, counted, and given their places by the plan.
    """
    cut = materialize(pieces(docs, tokenizer, end_id, size, with_ids), "pieces")
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, size, bins).table()
    earlier = Window.partitionBy("length").orderBy("part")
    bases = by_task.select("part", "length", (F.sum("n").over(earlier) - F.col("n")).alias("base"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = (batch.pop("base") + batch.pop("rank")).to_numpy()
            lengths, sequence = batch["length"].to_numpy(), np.zeros(len(batch), np.int64)
            for length in np.unique(lengths):
                at = lengths == length
                first, base, each = plan[int(length)]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = base[k] + (rank[at] - first[k]) // each[k]
            batch["sequence_id"] = sequence
            yield batch.drop(columns="part")

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    placed = cut.join(bases, ["part", "length"]).select(*kept, "rank", "base", "part")
    types = {"piece": "int", "ids": "array<long>"}
    fields = ", ".join(f"{x} {types.get(x, 'long')}" for x in [*kept, "sequence_id"])
    placed = placed.mapInPandas(place, fields)
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
    offset = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(*kept, "sequence_id", offset.alias("offset"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)
