"""State of resumable jobs, derived from an append-only attempt log.

``attempts(job_name, row_id, seq, ts, url, success, error_type, error_msg)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.timing import percent, seconds_between
from listwright.operators.dedupe import latest_per_key

ROW = ["job_name", "row_id"]


def _state_columns() -> list[Column]:
    good = F.when(F.col("success"), F.col("seq"))
    bad = F.when(~F.col("success"), F.col("seq"))
    failure = F.struct(
        "url", F.concat_ws(": ", "error_type", "error_msg").alias("error"), F.col("ts").alias("failed_at")
    )
    return [
        F.min(good).alias("first_success"),
        F.max(bad).alias("last_failure"),
        F.max_by(failure, bad).alias("failure"),
    ]


def attempt_state(attempts: DataFrame) -> DataFrame:
    """Per row whether it is completed and whether it carries a failure mark.

    Only the first success clears the mark; a later failure sets it again, so a
    row can be both.
    """
    return with_marks(attempts.groupBy(*ROW).agg(*_state_columns()))


def with_marks(state: DataFrame) -> DataFrame:
    completed = F.col("first_success").isNotNull()
    failed = F.col("last_failure").isNotNull() & (
        ~completed | (F.col("last_failure") > F.col("first_success"))
    )
    return state.withColumn("completed", completed).withColumn("failed", F.coalesce(failed, F.lit(False)))


def completed_rows(attempts: DataFrame) -> DataFrame:
    return attempts.where("success").select(*ROW).distinct()


def pending_rows(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rows without a success so far."""
    return rows.join(completed_rows(attempts), ROW, "left_anti")


def processed_rows(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rows whose URL was tried at all, with whatever outcome."""
    return rows.join(attempts.select("job_name", "url").distinct(), ["job_name", "url"], "left_semi")


def failed_rows(attempts: DataFrame) -> DataFrame:
    """Rows with a failure mark and their last failure."""
    return attempt_state(attempts).where("failed").select(*ROW, "failure.url", "failure.error", "failure.failed_at")


def stored_results(attempts: DataFrame, columns: list[str]) -> DataFrame:
    """What the last success of every row stored."""
    good = attempts.where("success").select(*ROW, "seq", *columns)
    return latest_per_key(good, ROW, F.col("seq")).drop("seq")


def resume_merge(
    rows: DataFrame,
    attempts: DataFrame,
    results: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Stored results of completed rows together with fresh ones of the others.

    ``results`` holds one stored result per completed row; ``compute`` maps the
    pending rows to the same columns.
    """
    done = results.join(completed_rows(attempts), ROW, "left_semi")
    return done.unionByName(compute(pending_rows(rows, attempts)), allowMissingColumns=True)


def job_progress(attempts: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One row per job: totals, position, times.

    ``totals(job_name, total)`` gives the planned number of rows; without it the
    rows seen in the log are the total.
    """
    per_row = with_marks(
        attempts.groupBy(*ROW).agg(
            *_state_columns()[:2], F.min("ts").alias("started"), F.max("ts").alias("updated")
        )
    )
    jobs = per_row.groupBy("job_name").agg(
        F.count("*").alias("seen"),
        F.count_if("completed").alias("completed"),
        F.count_if("failed").alias("failed"),
        (F.max("row_id") + 1).alias("position"),
        F.min("started").alias("started_at"),
        F.max("updated").alias("last_updated"),
    )
    if totals is not None:
        jobs = jobs.join(totals, "job_name", "left")
    else:
        jobs = jobs.withColumn("total", F.col("seen"))
    pending = F.col("total") - F.col("completed")
    return jobs.select(
        "job_name", "total", "completed", "failed",
        pending.alias("pending"),
        percent(F.col("completed"), F.col("total")).alias("percent_complete"),
        "position", "started_at", "last_updated",
        seconds_between(F.col("started_at"), F.col("last_updated")).alias("elapsed_seconds"),
        (pending == 0).alias("is_completed"),
    )
