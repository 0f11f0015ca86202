"""Structured Streaming forms of the long-running steps.

Every stream ends when the available input is used up unless another trigger is
given, and continues from its checkpoint on the next start.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from listwright.operators.attempts import ROW, _state_columns, with_marks
from listwright.operators.contacts import contact_cells, extract_contacts
from listwright.operators.dedupe import latest_per_key
from listwright.operators.metrics import metric_alerts
from listwright.operators.progress import progress_counters, with_speed
from listwright.session import DEFAULTS
from listwright.sources.listing_files import file_stream, scan, without_broken
from listwright.sources.readers import CSV_GLOB, PAGE_SCHEMA, _csv_options, _drop_long_lines, _listing_schema
from listwright.sources.writers import read_current, replace_in_place

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
EVERYTHING: dict[str, Any] = {"availableNow": True}


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def page_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Pages as they arrive in a folder."""
    return parquet_stream(spark, path, PAGE_SCHEMA, files_per_batch)


def listing_stream(
    spark: SparkSession, folder: str, columns: list[str], na_values: list[str], files_per_batch: int = 1000,
    same_header: bool = False,
) -> DataFrame:
    """New CSV files of a folder, each read once and under its own header.

    ``columns`` are the canonical names wanted, with ``source_file``, ``ordinal``
    and ``error``: a file that cannot be read is one row with ``error``, the
    stream goes on. A column that a file lacks is NULL. With ``same_header`` the
    files have just ``columns``, by place, and one with another header ends the stream.
    """
    if not same_header:
        return scan(file_stream(spark, folder, CSV_GLOB, files_per_batch), columns, na_values=na_values, isolate=True)
    raw = (
        spark.readStream.schema(_listing_schema(columns))
        .options(**_csv_options(False, same_header=True))
        .option("pathGlobFilter", CSV_GLOB)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .csv(folder)
    )
    return _drop_long_lines(raw, columns, na_values)


def read_listing_stream(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that a written listing stream read to their end, and the errors of the others."""
    return without_broken(spark.read.parquet(path))


def progress_log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def write_stream(
    df: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] = EVERYTHING, fmt: str = "parquet"
) -> StreamingQuery:
    """Append rows to a file sink, each exactly once."""
    return (
        df.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def extract_stream(pages: DataFrame, path: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Contacts of new pages; the extraction keeps no state."""
    return write_stream(contact_cells(extract_contacts(pages)), path, checkpoint, **options)


def write_updates(
    df: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] = EVERYTHING
) -> StreamingQuery:
    """Write the changed groups of an aggregation, one folder per micro-batch.

    A batch that is run again replaces its own folder, so a lost executor or a
    restart leaves no duplicates. :func:`read_updates` gives the current state.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _updates(spark: SparkSession, path: str) -> DataFrame:
    """The log since it was last compacted, and what was compacted; older batches are not read."""
    batches = spark.read.parquet(path)
    try:
        held = read_current(spark, f"{path}.compact")
    except AnalysisException:
        return batches
    upto = held.agg(F.max("batch_id")).first()[0]
    return batches.where(F.col("batch_id") > (-1 if upto is None else upto)).unionByName(held)


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return latest_per_key(_updates(spark, path), keys, F.col("batch_id")).drop("batch_id")


def compact_updates(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Store the current state beside the log; readers then leave the older batches alone."""
    replace_in_place(latest_per_key(_updates(spark, path), keys, F.col("batch_id")), f"{path}.compact")


def attempt_state_stream(
    attempts: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] = EVERYTHING
) -> StreamingQuery:
    """What each micro-batch adds to the state of its rows.

    First successes and last failures of batches merge into those of all, so the
    stream itself keeps no state at all, however many rows the log ever had: a row
    that is completed costs nothing any more until it is tried again.
    :func:`read_attempt_state` merges, :func:`compact_attempt_state` stores what was merged.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*ROW).agg(*_state_columns()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return attempts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _merged_attempts(spark: SparkSession, path: str) -> DataFrame:
    return _updates(spark, path).groupBy(*ROW).agg(
        F.min("first_success").alias("first_success"),
        F.max("last_failure").alias("last_failure"),
        F.max_by("failure", "last_failure").alias("failure"),
        F.max("batch_id").alias("batch_id"),
    )


def read_attempt_state(spark: SparkSession, path: str) -> DataFrame:
    return with_marks(_merged_attempts(spark, path).drop("batch_id"))


def compact_attempt_state(spark: SparkSession, path: str) -> None:
    """Store the merged state beside the log; readers then leave the older batches alone."""
    replace_in_place(_merged_attempts(spark, path), f"{path}.compact")


def progress_stream(items: DataFrame, path: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Running counters per job."""
    return write_updates(items.groupBy("job_name").agg(*progress_counters()), path, checkpoint, **options)


def read_progress(spark: SparkSession, path: str, total: Column | None = None) -> DataFrame:
    counters = read_updates(spark, path, ["job_name"])
    return with_speed(counters, F.col("processed_items") if total is None else total)


def alert_stream(samples: DataFrame, path: str, checkpoint: str, **options: Any) -> StreamingQuery:
    return write_stream(metric_alerts(samples), path, checkpoint, **options)


def ttl_dedupe(events: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """First event of a key; its repeats are dropped while the key lives.

    The watermark drives the lifetime, so a key may be held a little longer than
    ``ttl``. State is dropped when the watermark passes.
    """
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


class TtlMisses(StatefulProcessor):
    """Per key the end of its current lifetime; a timer drops it when the watermark has passed it.

    Events come in chunks. Those within the lifetime that the state knows are
    dropped at once, of the others only time, identity and place are kept until
    the chunks are read, for the order of a batch's events is not the order of time.
    """

    def __init__(self, key: str, ident: str, ts: str, ttl: int):
        self.key, self.ident, self.ts, self.ttl = key, ident, ts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alive = handle.getValueState("alive", "until bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.alive.get() if self.alive.exists() else None
        until = held[0] if held else None
        times, idents = [], []
        for chunk in rows:
            at = chunk[self.ts].to_numpy("datetime64[us]").astype("int64")
            open_ = np.flatnonzero(at >= until) if until is not None else np.arange(len(at))
            if len(open_):
                times.append(at[open_])
                idents.append(chunk[self.ident].to_numpy()[open_])
        if not times:
            return
        at, ident = np.concatenate(times), np.concatenate(idents)
        order = np.lexsort((ident, at))
        at, ident = at[order], ident[order]
        chosen, k = [], 0
        while k < len(at):
            chosen.append(k)
            until = int(at[k]) + self.ttl
            k = int(np.searchsorted(at, until))
        if held:
            self.handle.deleteTimer((held[0] + 999) // 1000)
        # A timer in the past would never fire; a lifetime that the watermark has passed needs no state.
        if until // 1000 > timerValues.getCurrentWatermarkInMs():
            self.alive.update((until,))
            self.handle.registerTimer((until + 999) // 1000)
        elif held:
            self.alive.clear()
        yield pd.DataFrame({self.key: key[0], self.ident: ident[chosen], self.ts: at[chosen].astype("datetime64[us]")})

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alive.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_misses(
    events: DataFrame, key: str, ident: str, ts: str, ttl_seconds: int, delay: str = "1 hour"
) -> DataFrame:
    """Events that find no live result and so start a new lifetime, exactly.

    Unlike :func:`ttl_dedupe` a key lives for ``ttl_seconds`` and not longer. Events
    may come in any order within ``delay``; micro-batches come in the order of
    time. Of a hot key a task holds 16 bytes for each event beyond the lifetime it
    knew before the batch, so a limit per batch (``files_per_batch``) bounds it.
    """
    schema = T.StructType([events.schema[c] for c in (key, ident, ts)])
    # Timers and values are families of their own, which only this store has.
    events.sparkSession.conf.set(STATE_STORE, DEFAULTS[STATE_STORE])
    return (
        events.select(key, ident, ts)
        .withWatermark(ts, delay)
        .groupBy(key)
        .transformWithStateInPandas(TtlMisses(key, ident, ts, ttl_seconds * 1_000_000), schema, "append", "EventTime")
    )
