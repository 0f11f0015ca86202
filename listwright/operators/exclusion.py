"""Dropping addresses that contain an unwanted word."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.patterns import trie_regex
from listwright.functions.text import rejoin_emails, split_emails, strip
from listwright.operators.skew import skew_join
from listwright.session import materialize

# Words are looked for where their first characters occur.
HEAD_CHARS = 4


def is_excluded(email: Column, tokens: Iterable[str], whole_word: bool = False) -> Column:
    """Does the lower-cased address contain any of the words?"""
    pattern = trie_regex(tokens)
    if pattern is None:
        return F.lit(False)
    if whole_word:
        pattern = r"(?<![\p{L}\p{N}])" + pattern + r"(?![\p{L}\p{N}])"
    return F.coalesce(F.lower(email).rlike(pattern), F.lit(False))


def exclude_emails(
    df: DataFrame, tokens: Iterable[str], email: str = "email", whole_word: bool = False
) -> DataFrame:
    """Replace the cell by its remaining addresses and note how many there were."""
    tokens = list(tokens)
    kept = F.filter("_given", lambda e: ~is_excluded(e, tokens, whole_word))
    return (
        df.withColumn("_given", split_emails(F.col(email)))
        .withColumn("_kept", kept)
        .withColumn("given_count", F.size("_given"))
        .withColumn("kept_count", F.size("_kept"))
        .withColumn(email, rejoin_emails(F.col("_kept")))
        .drop("_given", "_kept")
    )


def usable_words(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Distinct words as they are compared: trimmed, lower case, no blank and no NULL ones."""
    words = tokens.select(F.lower(strip(F.col(token).cast("string"))).alias("token"))
    return words.where(F.col("token").isNotNull() & (F.col("token") != "")).distinct()


def exclude_emails_by_table(df: DataFrame, tokens: DataFrame, row_key: str, email: str = "email") -> DataFrame:
    """As :func:`exclude_emails` for a table ``tokens(token)``, in one form for every size.

    No word reaches the driver. The addresses are stored once, so ``df`` is read
    twice: for them and for the result.
    """
    words = materialize(usable_words(tokens), "words")
    addresses = df.select(row_key, F.posexplode(split_emails(F.col(email))).alias("_pos", "_address"))
    addresses = materialize(addresses, "addresses")
    hit = addresses_with_token(addresses.select("_address").distinct(), "_address", words)
    unwanted = skew_join(addresses, hit, "_address", how="left_semi")
    # A group is one cell, so what is listed here is bounded by the cell.
    cells = unwanted.groupBy(row_key).agg(F.collect_set("_pos").alias("_out"))
    no_positions = F.array().cast("array<int>")
    return (
        df.join(cells, row_key, "left")
        .withColumn("_given", split_emails(F.col(email)))
        .withColumn("_out", F.coalesce("_out", no_positions))
        .withColumn("_kept", F.filter("_given", lambda e, i: ~F.array_contains(F.col("_out"), i)))
        .withColumn("given_count", F.size("_given"))
        .withColumn("kept_count", F.size("_kept"))
        .withColumn(email, rejoin_emails(F.col("_kept")))
        .select(*df.columns, "given_count", "kept_count")
    )


def addresses_with_token(addresses: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Distinct addresses that contain a word of ``words(token)``, by equality on substrings.

    Where an address contains the beginning of a word, its substrings of the
    lengths of such words are compared. A substring meets at most one word, so
    no candidate pairs arise. Common beginnings and substrings are large
    partitions on the left of a join, which Spark splits.
    """
    # One number: words shorter than a beginning shorten all beginnings.
    shortest = words.agg(F.min(F.length("token"))).first()[0]
    head = min(HEAD_CHARS, shortest or HEAD_CHARS)
    parts = words.select(F.col("token").alias("_part"))
    heads = parts.groupBy(F.left("_part", F.lit(head)).alias("_head")).agg(
        F.collect_set(F.length("_part")).alias("_lengths")
    )
    spots = (
        addresses.select(column, F.lower(column).alias("_low"))
        .where(F.length("_low") >= head)
        .select("*", F.explode(F.sequence(F.lit(1), F.length("_low") - (head - 1))).alias("_start"))
        .withColumn("_head", F.substr("_low", F.col("_start"), F.lit(head)))
    )
    pieces = (
        spots.join(heads, "_head")
        .select(column, "_low", "_start", F.explode("_lengths").alias("_length"))
        .where(F.col("_start") + F.col("_length") - 1 <= F.length("_low"))
        .select(column, F.substr("_low", F.col("_start"), F.col("_length")).alias("_part"))
    )
    return pieces.join(parts, "_part", "left_semi").select(column).distinct()


def exclusion_counts(df: DataFrame, email: str = "email") -> DataFrame:
    """Totals over the output of an exclusion: one row.

    ``distinct_counts`` is the number of different per-row counts, which is what
    the original report calls "remaining".
    """
    per_address = df.select(
        "given_count", "kept_count", F.posexplode_outer(split_emails(F.col(email))).alias("_pos", "_address")
    )
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    return per_address.agg(
        F.coalesce(F.sum(F.when(first, F.col("given_count") - F.col("kept_count"))), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(first, F.col("kept_count"))), F.lit(0)).alias("remaining"),
        F.count_distinct("_address").alias("distinct_emails"),
        F.count_distinct("kept_count").alias("distinct_counts"),
    )
