"""Token ids in fixed-width bit packing, with random access (operator 2).

A segment is the image of one binary file::

    magic "LWBP", u16 version, u16 bits, u32 ids per block, u64 documents, u64 ids
    u8  for each document: 1 if it has a doc_id
    i64 for each document: doc_id (0 if it has none)
    u64 for each document: ids before it in the segment, and one more: all ids
    u64 for each block: its first byte within the packed part, and one more: the end
    the packed ids; a block starts at a whole byte

all little-endian. Each id takes the bits that the largest id of the vocabulary
needs. A block is unpacked by itself, so any id is reached without those before
it. Segments are rows of a Parquet table, whose writer commits a task's output
as a whole: a lost executor leaves no half-written file, on any file system.

Defined cases: a null or empty text has the end id alone; a null doc_id comes
first and stays null; rows that share a doc_id are kept, ordered by text; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import beside, query, shared_dir, table

MAGIC, VERSION = b"LWBP", 1
HEADER = struct.Struct("<4sHHIQQ")
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 20  # a segment closes when it holds this many ids
START_CHARS = 128


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids one after the other, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shown = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(shown.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    shown = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    return shown.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def segment(doc_ids: list, counts: list[int], ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """The image of one file."""
    blocks = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    known = [x is not None for x in doc_ids]
    return b"".join([
        HEADER.pack(MAGIC, VERSION, bits, block, len(doc_ids), len(ids)),
        np.array(known, np.uint8).tobytes(),
        np.array([x if x is not None else 0 for x in doc_ids], "<i8").tobytes(),
        np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype("<u8").tobytes(),
        np.cumsum([0] + [len(x) for x in blocks]).astype("<u8").tobytes(),
        *blocks,
    ])


class Segment:
    """Reads an image: ``ids(a, b)`` touches only the blocks between."""

    def __init__(self, image: bytes):
        magic, version, self.bits, self.block, n_docs, self.n_ids = HEADER.unpack_from(image)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a packed segment")
        at = HEADER.size
        self.known = np.frombuffer(image, np.uint8, n_docs, at).astype(bool)
        at += n_docs
        self.doc_ids = np.frombuffer(image, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(image, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(image, "<u8", n_blocks + 1, at).astype(np.int64)
        self.image, self.body = image, at + 8 * (n_blocks + 1)

    def ids(self, a: int, b: int) -> np.ndarray:
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError(f"ids {a} to {b} of {self.n_ids}")
        if a == b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            data = self.image[self.body + self.offsets[k] : self.body + self.offsets[k + 1]]
            parts.append(unpack(data, min(self.block, self.n_ids - k * self.block), self.bits))
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts and write them as segments in ascending doc_id order.

    Columns of the table: ``part`` and ``seg`` (together the order), ``n_docs``,
    ``n_ids``, ``image``. Texts are dealt out by ranges of doc_id and, within one
    doc_id, of their first ``START_CHARS`` characters; rows equal in doc_id and a text no longer
    than that go by their place in the input. So only rows that share a doc_id and
    the beginning of longer texts stay in one task, which holds one segment at a time.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from listwright.llm.encoding import encoder

        enc = encoder(tokenizer)
        bits = bits_for(max(enc.vocabulary(), end_id + 1))
        part, seg = TaskContext.get().partitionId(), 0
        names, counts, parts, held = [], [], [], 0

        def close() -> pd.DataFrame:
            return pd.DataFrame({
                "part": [part], "seg": [seg], "n_docs": [len(names)], "n_ids": [held],
                "image": [segment(names, counts, np.concatenate(parts), bits)],
            })

        for batch in batches:
            ids, sizes = enc.encode(batch["text"].tolist())
            at = 0
            for known, doc_id, size in zip(batch["known"], batch["doc_id"], sizes.tolist(), strict=True):
                names.append(int(doc_id) if known else None)
                parts.append(np.append(ids[at : at + size], np.uint32(end_id)))
                counts.append(size + 1)
                at, held = at + size, held + size + 1
                if held >= segment_ids:
                    yield close()
                    seg, names, counts, parts, held = seg + 1, [], [], [], 0
        if names:
            yield close()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # A text that ends within its beginning comes before the longer ones, so these keys follow the order by text.
    more = F.length("text") > START_CHARS
    rows = rows.select("*", F.substring("text", 1, START_CHARS).alias("begin"), more.alias("more"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("key", "begin", "more", F.when(~F.col("more"), F.col("row"))).sortWithinPartitions("key", "text")
    rows = rows.select(F.col("key").isNotNull().alias("known"), F.coalesce("key", F.lit(0)).alias("doc_id"), "text")
    rows.mapInPandas(encode, "part long, seg long, n_docs long, n_ids long, image binary").write.mode("overwrite").parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, seg, before``: ids of all segments before each one.

    Parts are summed first; the window over all of them has a row for each
    writing task, not for each segment.
    """
    segments = spark.read.parquet(path).select("part", "seg", "n_ids")
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_before"))
    within = Window.partitionBy("part").orderBy("seg")
    return (
        segments.withColumn("seg_before", F.sum("n_ids").over(within) - F.col("n_ids"))
        .join(parts, "part")
        .select("part", "seg", (F.col("part_before") + F.col("seg_before")).alias("before"))
    )


def read_packed(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of every document, from the files alone."""
    fields = "part long, seg long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seg, image in zip(batch["part"], batch["seg"], batch["image"], strict=True):
                one = Segment(image)
                flat = one.ids(0, one.n_ids)
                texts = [flat[a:b] for a, b in zip(one.starts[:-1], one.starts[1:], strict=True)]
                out = pd.DataFrame({
                    "part": part, "seg": seg,
                    "doc_id": pd.array(np.where(one.known, one.doc_ids, 0), "Int64"),
                    "at": one.starts[:-1], "n_tokens": np.diff(one.starts),
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in texts],
                })
                out.loc[~one.known, "doc_id"] = pd.NA
                if with_ids:
                    out["ids"] = [x.astype(np.int64) for x in texts]
                yield out

    rows = spark.read.parquet(path).select("part", "seg", "image").mapInPandas(decode, fields)
    return rows.join(segment_starts(spark, path), ["part", "seg"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []),
    )


def segments_between(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """The segments that hold ids from place ``start`` to before ``end``.

    They follow one another, so their first and last ``(part, seg)`` say which they
    are. Both stand as constants in the scan's filter: Parquet leaves out the row groups and pages
    of all other images.
    """
    segments = spark.read.parquet(path)
    known = segments.select("part", "seg", "n_ids").join(segment_starts(spark, path), ["part", "seg"])
    hit = known.where((F.col("before") < end) & (F.col("before") + F.col("n_ids") > start))
    at = F.struct("part", "seg")
    ends = hit.agg(F.min(at).alias("first"), F.max(at).alias("last")).first()
    if ends["first"] is None:
        return segments.where("false")
    (p, a), (q, b) = ends["first"], ends["last"]
    part, seg = F.col("part"), F.col("seg")
    inside = part.between(p, q) & ((part > p) | (seg >= a)) & ((part < q) | (seg <= b))
    return segments.where(inside & seg.between(a, b) if p == q else inside)


def read_ids(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """``place, id`` of ``count`` ids from place ``start`` on: only segments in that range are read, and only its blocks unpacked."""
    end = start + count
    hit = segments_between(spark, path, start, end)
    hit = hit.join(beside(segment_starts(spark, path).join(hit.select("part", "seg"), ["part", "seg"])), ["part", "seg"])
    hit = hit.select("before", "n_ids", "image")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for before, n_ids, image in zip(batch["before"], batch["n_ids"], batch["image"], strict=True):
                a, b = max(0, start - before), min(n_ids, end - before)
                yield pd.DataFrame({"place": np.arange(before + a, before + b), "id": Segment(image).ids(a, b).astype(np.int64)})

    return hit.mapInPandas(cut, "place long, id long")


@query
def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed ids, read back from the files."""
    import public_tokenizers

    path = shared_dir(spark, "packed")
    write_packed(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_packed(spark, path, with_ids=False)
