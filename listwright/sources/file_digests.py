"""Hashes of files of any size, and files with equal contents.

Files are read in pieces inside tasks, never as one cell. Copies are looked for
step by step: only files that share their size are opened at all, only those that
share size and beginning are read to the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.session import materialize
from listwright.sources.listing_files import arrow_uri

PIECE_BYTES = 1 << 22
HEAD_BYTES = 1 << 16
TASK_BYTES = 1 << 28


def with_digest(files: DataFrame, name: str = "content_md5", first: int | None = None, tasks: int | None = None) -> DataFrame:
    """Files (``path, length`` and whatever else) with the md5 of their contents, or of their ``first`` bytes.

    A file is read by one task, ``PIECE_BYTES`` at a time; many files spread over all tasks.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                filesystem, local = fs.FileSystem.from_uri(arrow_uri(path))
                own, left = md5(usedforsecurity=False), first
                with filesystem.open_input_stream(local, buffer_size=0) as stream:
                    while left is None or left > 0:
                        piece = stream.read(PIECE_BYTES if left is None else min(PIECE_BYTES, left))
                        if not piece:
                            break
                        own.update(piece)
                        left = None if left is None else left - len(piece)
                found.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    schema = files.schema.add(name, "string")
    dealt = files.repartition(tasks or 4 * files.sparkSession.sparkContext.defaultParallelism, "path")
    # A batch of paths is small; their contents are not, so batches stay short.
    return dealt.mapInArrow(digest, schema)


def digest_tasks(files: DataFrame) -> int:
    """Tasks for all bytes of the files."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return int(max(4 * files.sparkSession.sparkContext.defaultParallelism, min(total // TASK_BYTES + 1, 200_000)))


def _shared(files: DataFrame, *keys: str) -> DataFrame:
    """Files that share ``keys`` with another, by a semi-join with the keys that repeat."""
    again = files.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return files.join(again, list(keys), "left_semi")


def copies(files: DataFrame, keep: list[Column | str] | None = None) -> DataFrame:
    """``path, length, head_md5, content_md5`` (and what ``keep`` names) of all files that have a copy. Empty files have none.

    The sizes come from the listing. Files of a size of their own are never
    opened, files with a beginning of their own are read no further. Each step is
    stored, so a lost task opens its own files again and no others.
    """
    listed = files.where("length > 0").select("path", "length", *(keep or []))
    listed = materialize(listed, "listed")
    same_size = materialize(_shared(listed, "length"), "same-size")
    tasks = digest_tasks(same_size)
    heads = materialize(with_digest(same_size, "head_md5", HEAD_BYTES, tasks), "heads")
    same_head = materialize(_shared(heads, "length", "head_md5"), "same-head")
    # A file no longer than its beginning has been read already.
    short = same_head.where(F.col("length") <= HEAD_BYTES).withColumn("content_md5", F.col("head_md5"))
    long = with_digest(same_head.where(F.col("length") > HEAD_BYTES), tasks=tasks)
    return _shared(materialize(short.unionByName(long), "digests"), "length", "content_md5")
