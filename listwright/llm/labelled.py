"""Labelled rows that models learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the rows that no model learns from; a row without a doc_id belongs to it."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, each: bool = False) -> DataFrame:
    """``text, label`` of at most ``rows`` training documents (``each``: of either label).

    The rows with the smallest hashes of their doc_id are taken, so the sample is
    the same at every run and does not depend on order or partitions. Of a
    document labelled twice, the larger label counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    first = [F.xxhash64("doc_id"), "doc_id"]
    if each:
        chosen = known.where("label = 1").orderBy(*first).limit(rows).unionAll(known.where("label = 0").orderBy(*first).limit(rows))
    else:
        chosen = known.orderBy(*first).limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
