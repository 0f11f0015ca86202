"""Row numbers of a whole table, without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.session import materialize

LOCAL = (1 << 33) - 1


def with_place(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place in ``order``, counted from 1.

    Rows are range-partitioned by the order, sorted where they lie, and stored
    with their place in the partition. One count per partition is then added up
    on the driver and handed back, so nothing grows with the rows but the sort.
    ``order`` should end in a key: equal rows would stay in one partition.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ordered.withColumn("__lw_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__lw_at", 33)
    # Partition numbers and row numbers of a stored table; one row a partition reaches the driver.
    counts = sorted((r["part"], r["n"]) for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)] or [(0, 0)], "__lw_part long, __lw_start long")
    numbered = stored.join(F.broadcast(starts), part == F.col("__lw_part"))
    return numbered.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__lw_start") + F.col("__lw_at").bitwiseAND(LOCAL) + 1).alias(name))
