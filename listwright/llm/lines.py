"""Line dedup: maximal repeated runs of lines, found by prefix doubling (operator 5, DataFrame operations only).

A document is its sequence of lines with words. Lines get an id by their sorted
order; ranks of suffixes are then doubled: the rank by the first 2h lines is the
sorted order of the pair (rank by h at a line, rank by h at the line h further
on). Suffixes whose rank no other one has are settled and leave, so every round
holds only what is repeated to that length. A rank is an interval of the suffix
array whose longest common prefix is at least h, and two such intervals that
overlap describe common prefixes of every length between h and 2h.

A run of lines counts as repeated if it has at least ``MIN_WORDS`` words and
occurs elsewhere before. All maximal runs are covered by shortest runs: those
that reach the words from their first line on, and those that reach them back
from their last line. For each of these, the common-prefix interval that holds
it names its first occurrence; the others are later copies, and the lines that
they cover are deleted.

Order is (doc_id, hash of the text, line). Lines are compared without blanks
around them; words are separated by blanks.

Defined cases: null and empty texts stay as they are; rows equal in doc_id and
text are one document and get the same result; a null doc_id comes first; lines without words stay
and neither break nor make a run; a text whose lines all go becomes empty;
other columns are kept, also those named like internal ones; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import SQL, materialize, query, table

MIN_WORDS = 50
DOC = ["d", "h"]


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Number and text hash that together stand for a document."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long")).alias("d"),
        F.xxhash64(F.col(text).cast("string")).alias("h"),
    ]


def lines_of(docs: DataFrame) -> DataFrame:
    """``d, h, s, i, k1, k2, w``: number among lines with words, number among all lines, what the line is, its words."""
    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("line")))
    some = docs.where(F.col("text").isNotNull()).select(*doc_key(), F.posexplode(F.filter(lines, lambda x: x["line"] != "")).alias("s", "x"))
    return some.select(
        *DOC, F.col("s").cast("long").alias("s"), F.col("x.i").alias("i"),
        F.xxhash64("x.line").alias("k1"), F.xxhash64(F.lit(1), "x.line").alias("k2"),
        F.size(F.split("x.line", " +")).cast("long").alias("w"),
    )


def ranked(pairs: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Ranks, in sorted order, of the pairs that occur more than once."""
    counts = pairs.groupBy(first, second).agg(F.count("*").alias("n")).where("n > 1")
    ranks = counts.orderBy(first, second).select(first, second, F.monotonically_increasing_id().alias("rank"))
    return materialize(ranks, name)  # fixed before anything refers to them


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines that occur more than once, with their rank: ``d, h, s, i, w, rank``."""
    lines = materialize(lines_of(docs), "lines")
    ranks = ranked(lines, "k1", "k2", "line-ranks")
    found = lines.join(ranks, ["k1", "k2"]).groupBy(*DOC, "s").agg(*(F.first(x).alias(x) for x in ("i", "w", "rank")))
    return materialize(found, "repeated-lines")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """``d, h, a, e``: from each line, forwards and backwards, the shortest run with enough words.

    Words are added up within stretches of neighbouring repeated lines, so the
    end of a run is a range of that sum.
    """
    in_doc = Window.partitionBy(*DOC).orderBy("s")
    stretch = lines.withColumn("stretch", F.col("s") - F.row_number().over(in_doc))
    within = Window.partitionBy(*DOC, "stretch").orderBy("s")
    sums = stretch.withColumn("till", F.sum("w").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("from", F.col("till") - F.col("w"))
    ahead = Window.partitionBy(*DOC, "stretch").orderBy("from").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy(*DOC, "stretch").orderBy("till").rangeBetween(1 - min_words, 0)
    both = sums.select(
        *DOC, "s", "from", "till",
        F.max("s").over(ahead).alias("ahead"), F.max("till").over(ahead).alias("reached"),
        F.min("s").over(behind).alias("behind"), F.min("from").over(behind).alias("began"),
    )
    forwards = both.where(F.col("reached") - F.col("from") >= min_words).select(*DOC, F.col("s").alias("a"), F.col("ahead").alias("e"))
    backwards = both.where(F.col("till") - F.col("began") >= min_words).select(*DOC, F.col("behind").alias("a"), F.col("s").alias("e"))
    return forwards.unionAll(backwards).distinct()


def doubled(ranks: DataFrame, h: int) -> DataFrame:
    """Ranks by the first 2h lines of the suffixes that share them with another: ``d, h, s, rank``."""
    further = Window.partitionBy(*DOC).orderBy("s").rangeBetween(h, h)
    pairs = ranks.select(*DOC, "s", F.col("rank").alias("r1"), F.max("rank").over(further).alias("r2")).where("r2 IS NOT NULL")
    pairs = materialize(pairs, "pairs")
    names = ranked(pairs, "r1", "r2", "ranks")
    return materialize(pairs.join(names, ["r1", "r2"]).select(*DOC, "s", "rank"), "doubled")


def copied_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``d, h, i`` of the lines in later copies of repeated runs."""
    lines = repeated_lines(docs)
    runs = materialize(shortest_runs(lines, min_words), "runs")
    size = F.col("e") - F.col("a") + 1
    longest = runs.agg(F.max(size)).first()[0] or 0
    ranks, h, intervals = lines.select(*DOC, "s", "rank"), 1, None
    while h <= longest:
        here = runs.where((size >= h) & (size < 2 * h))
        start = ranks.select(*DOC, F.col("s").alias("a"), F.col("rank").alias("r1"))
        end = ranks.select(*DOC, (F.col("s") + F.lit(h - 1)).alias("e"), F.col("rank").alias("r2"))
        some = here.join(start, [*DOC, "a"]).join(end, [*DOC, "e"]).select(*DOC, "a", "e", "r1", "r2", size.alias("size"))
        intervals = some if intervals is None else intervals.unionAll(some)
        if 2 * h <= longest:
            ranks = doubled(ranks, h)
        h *= 2
    if intervals is None:
        return lines.select(*DOC, "i").limit(0)
    intervals = materialize(intervals, "intervals")
    same = ["size", "r1", "r2"]
    first = intervals.groupBy(*same).agg(F.min(F.struct(*DOC, "a")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # As a table of its own, so that Spark can split the intervals of a very common run in the join.
    first = materialize(first, "firsts")
    copies = intervals.join(first, same).where(F.struct(*DOC, "a") != F.col("first"))
    reach = copies.groupBy(*DOC, F.col("a").alias("s")).agg(F.max("e").alias("e"))
    so_far = Window.partitionBy(*DOC).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    covered = lines.join(reach, [*DOC, "s"], "left").withColumn("reach", F.max("e").over(so_far))
    return covered.where("reach >= s").select(*DOC, "i")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """The documents without later copies of repeated runs; ``removed`` names a column for the number of deleted lines."""
    gone = copied_lines(docs, min_words)
    in_doc = Window.partitionBy(*DOC).orderBy("i")
    stretch = gone.withColumn("stretch", F.col("i") - F.row_number().over(in_doc)).groupBy(*DOC, "stretch").agg(
        F.min("i").alias("start"), F.max("i").alias("end"),
    )
    cuts = stretch.groupBy(*DOC).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"),
        F.sum(F.col("end") - F.col("start") + 1).alias("gone"),
    )
    # What stays lies between the cuts, so the work follows the lines, not lines times cuts.
    edges = cuts.select(
        *DOC, "gone",
        F.arrays_zip(
            F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: x["end"] + 1)).alias("a"),
            F.concat(F.transform("cuts", lambda x: x["start"]), F.array(F.lit(2**31 - 1))).alias("b"),
        ).alias("stay"),
    )
    inner = edges.select(F.struct(*DOC).alias("__lw_key"), F.col("gone").alias("__lw_gone"), F.col("stay").alias("__lw_stay"))
    joined = docs.withColumn("__lw_key", F.struct(*doc_key())).join(inner, "__lw_key", "left")
    split = F.split(F.col("text").cast("string"), "\n")
    kept = F.flatten(F.transform("__lw_stay", lambda x: F.slice(split, x["a"] + 1, F.greatest(F.lit(0), F.least(x["b"], F.size(split)) - x["a"]))))
    text = F.when(F.col("__lw_stay").isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias("text") if x == "text" else F.col(f"`{x}`") for x in docs.columns if x != removed]
    if removed:
        out.append(F.coalesce("__lw_gone", F.lit(0)).cast("long").alias(removed))
    return joined.select(*out)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated runs of lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, removed="lines_removed").select("doc_id", "lines_removed", "text")


def line_dedup_sql(source: str, columns: str, words: int = MIN_WORDS) -> str:
    """The same in DuckDB's SQL, by the text of every shortest run; a table expression of ``columns`` and ``lines_removed``."""
    return f"""
WITH documents_in AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS doc_no FROM {source}),
all_lines AS (
    SELECT doc_no, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents_in WHERE text IS NOT NULL),
lines AS (
    SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY i) AS s, trim(line, ' ') AS t,
           len(regexp_split_to_array(trim(line, ' '), ' +')) AS w
    FROM all_lines WHERE trim(line, ' ') <> ''),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_no ORDER BY s) AS till, sum(w) OVER (PARTITION BY doc_no ORDER BY s) - w AS begun FROM lines),
reach AS (
    SELECT doc_no, s, begun, till,
           max(s) OVER ahead AS e, max(till) OVER ahead AS e_till, string_agg(t, chr(10)) OVER ahead AS run,
           min(s) OVER behind AS b, min(begun) OVER behind AS b_begun, string_agg(t, chr(10)) OVER behind AS back_run
    FROM sums
    WINDOW ahead AS (PARTITION BY doc_no ORDER BY begun RANGE BETWEEN CURRENT ROW AND {words - 1} FOLLOWING),
           behind AS (PARTITION BY doc_no ORDER BY till RANGE BETWEEN {words - 1} PRECEDING AND CURRENT ROW)),
runs AS (
    SELECT doc_no, s AS a, e, md5(run) AS run FROM reach WHERE e_till - begun >= {words}
    UNION
    SELECT doc_no, b, s, md5(back_run) FROM reach WHERE till - b_begun >= {words}),
firsts AS (SELECT run, min((doc_no, a)) AS f, count(*) AS n FROM runs GROUP BY run HAVING count(*) > 1),
copies AS (SELECT doc_no, a, max(e) AS e FROM runs JOIN firsts USING (run) WHERE (doc_no, a) <> f GROUP BY doc_no, a),
cover AS (
    SELECT l.doc_no, l.i, l.s, max(c.e) OVER (PARTITION BY l.doc_no ORDER BY l.s) AS reached
    FROM lines l LEFT JOIN copies c ON c.doc_no = l.doc_no AND c.a = l.s),
kept AS (
    SELECT x.doc_no, string_agg(x.line, chr(10) ORDER BY x.i) FILTER (WHERE c.reached IS NULL OR c.reached < c.s) AS text,
           count(*) FILTER (WHERE c.reached >= c.s) AS lines_removed
    FROM all_lines x LEFT JOIN cover c ON c.doc_no = x.doc_no AND c.i = x.i GROUP BY x.doc_no)
SELECT {columns}, CASE WHEN documents_in.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(lines_removed, 0)::BIGINT AS lines_removed
FROM documents_in LEFT JOIN kept USING (doc_no)"""


SQL["op5_line_dedup"] = line_dedup_sql("documents", "doc_id")
