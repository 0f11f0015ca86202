"""From raw documents to packed token sequences, in five stages.

Each stage works on all documents that the one before kept, and its decision
takes effect:

1. ``quality_classifier`` drops documents that score below the threshold.
2. ``line_dedup`` deletes later copies of repeated runs of lines.
3. ``ngram_jaccard_join`` keeps one row of each group of near copies, one with
   the smallest doc_id (one without a doc_id only if none has one).
4. ``benchmark_decontamination`` drops documents that hold a test item.
5. ``best_fit_packing`` gives every token a place in a sequence.

``run`` writes the result of each stage to the shared folder and reads it again,
so a lost executor never brings back an earlier stage.

Defined cases are those of the operators; ``n_chars`` follows the text where the
documents have it; rows equal in doc_id and text share their fate until stage 3 keeps one of them, the first by the other
columns; documents without words are kept, as nothing is a copy of nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import beside, materialize, on_workers, table
from listwright.llm.decontamination import decontaminate
from listwright.llm.jaccard import jaccard_components
from listwright.llm.lines import dedup_lines
from listwright.llm.packing import pack_documents
from listwright.llm.quality import THRESHOLD, fit_quality, quality_score

SEQUENCE_TOKENS = 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject."""
    on_workers(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(model) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of repeated runs of lines."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{x}`") for x in docs.columns))


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row of those equal in ``key`` and text, the first by the other columns; combined before the shuffle, so a key may hold any share of the rows."""
    others = [x for x in rows.columns if x not in (key, "text")]
    ordered = [F.col(f"`{x}`") for x in others if "map<" not in rows.schema[x].dataType.simpleString()]
    row = F.struct(*(F.col(f"`{x}`") for x in others))
    return rows.groupBy(key, "text").agg(F.min_by(row, F.struct(*ordered)).alias("__lw_row")).select("text", *(F.col(f"__lw_row.`{x}`") for x in others))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at a similarity of 0.8 or more."""
    on_workers(spark)
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")
    found = jaccard_components(docs, n=5, percent=80)
    # Only documents with words can be copies; the first of each component stays.
    some = materialize(found.where("n_shingles > 0"), "near-copies")
    stays = some.groupBy("component").agg(F.min(first).alias("first"))
    gone = some.join(stays, "component").where(first != F.col("first")).select(F.struct("doc_id", "h").alias("__lw_doc")).distinct()
    gone = beside(materialize(gone, "gone"))
    # Rows equal in doc_id and text all equal the first; the anti-join keeps every one.
    again = some.groupBy("doc_id", "h").count().where("count > 1").select(F.struct("doc_id", "h").alias("__lw_doc"))
    again = materialize(again, "again")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    kept = docs.withColumn("__lw_doc", key)
    kept = kept.join(gone, kept["__lw_doc"].eqNullSafe(gone["__lw_doc"]), "left_anti")
    columns = [F.col(f"`{x}`") for x in docs.columns]
    if again.isEmpty():
        return kept.select(*columns)
    again = beside(again)
    same = kept["__lw_doc"].eqNullSafe(again["__lw_doc"])
    once, more = kept.join(again, same, "left_anti"), kept.join(again, same, "left_semi")
    return once.select(*columns).unionByName(first_rows(more, "__lw_doc").select(*columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no test item."""
    on_workers(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    import public_tokenizers

    on_workers(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, size=SEQUENCE_TOKENS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# A trained model, subword ids and a heuristic packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
