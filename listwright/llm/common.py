"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.session import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROOT = str(Path(__file__).resolve().parents[2])


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed but lies in the same place (local sessions).

    On a cluster, install the package or pass it with ``--py-files``.
    """
    known = spark.sparkContext.environment
    paths = [x for x in known.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under the function's name."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


BROADCAST_ROWS = 500_000


def beside(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of short rows for a join with texts: broadcast while it has at most ``limit`` rows.

    Beyond that the join is left to Spark, which shuffles the texts.
    """
    return F.broadcast(rows) if rows.count() <= limit else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


__all__ = ["QUERIES", "SQL", "beside", "materialize", "on_workers", "query", "shared_dir", "table"]
