"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import materialize

ROUNDS = 60


def components(links: DataFrame, name: str) -> DataFrame:
    """``node, component`` (its smallest node) of all nodes in ``links`` (``a, b``, long).

    Stars are drawn large and small by turns: every node hands its neighbours to
    the smallest of them, which halves chains. Only smallest neighbours are
    aggregated, so a node with very many links is no larger than others. Each
    round is a written table.
    """
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    stars = materialize(links.where("a != b").select(*ends).distinct(), name)
    before = None
    for _ in range(ROUNDS):
        sign = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        before = tuple(sign)
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        stars = materialize(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a != b").distinct(), name)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
