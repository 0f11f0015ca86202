"""Reuse of earlier results for as long as they live.

``cache(key, value, created_at, expires_at)`` keeps every version that was ever
stored; the version written last before a request is the one that counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions.timing import is_live, ratio
from listwright.operators.dedupe import latest_per_key
from listwright.session import materialize

SLOT_SECONDS = 3600
SLOT_ROWS = 500_000  # rows of a key and slot that one task may have
BROADCAST_SLOTS = 200_000


def live_entries(cache: DataFrame, at: Column) -> DataFrame:
    return cache.where(is_live(F.col("expires_at"), at))


def expired_entries(cache: DataFrame, at: Column) -> DataFrame:
    """What a purge at that time removes: an entry that expires now is gone."""
    return cache.where(~is_live(F.col("expires_at"), at))


def current_entries(cache: DataFrame) -> DataFrame:
    """The last version per key."""
    return latest_per_key(cache, ["key"], F.struct("created_at", "value"))


def _adaptive_slots(rows: DataFrame, width: int, most: int) -> DataFrame:
    """``rows`` (``key, _us``) with ``_slot``: their time slot, cut evenly where a key has more than ``most`` rows in it.

    A count per key and slot, combined before the shuffle, finds the few slots to
    cut; each is cut into as many parts of equal time as it has times ``most``
    rows. Rows of one instant stay together. Without such slots nothing is joined.
    """
    wide = rows.withColumn("_wide", F.floor(F.col("_us") / F.lit(width)))
    hot = wide.groupBy("key", "_wide").agg(F.count("*").alias("_n"), F.min("_us").alias("_from"), F.max("_us").alias("_to"))
    hot = materialize(hot.where(F.col("_n") > most), "hot-slots")
    if hot.isEmpty():
        return wide.select("*", F.struct("_wide", F.lit(0).cast("long").alias("_cut")).alias("_slot")).drop("_wide")
    step = F.greatest(F.lit(1), F.ceil((F.col("_to") - F.col("_from") + 1) * most / F.col("_n"))).cast("long")
    cuts = hot.select(F.col("key").alias("_key"), F.col("_wide").alias("_hot"), "_from", step.alias("_step"))
    if cuts.count() <= BROADCAST_SLOTS:
        cuts = F.broadcast(cuts)
    joined = wide.join(cuts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_wide") == F.col("_hot")), "left")
    cut = F.coalesce(F.floor((F.col("_us") - F.col("_from")) / F.col("_step")), F.lit(0)).cast("long")
    return joined.withColumn("_slot", F.struct("_wide", cut.alias("_cut"))).drop("_wide", "_key", "_hot", "_from", "_step")


def cache_lookup(
    requests: DataFrame, cache: DataFrame, slot_seconds: int = SLOT_SECONDS, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """Answer each request from the version that was current at its time.

    Requests and versions are never paired. Both are cut into time slots, and a
    key's slot with more than ``slot_rows`` rows into finer ones, so a key that holds
    a third of all rows is spread over as many tasks, even within one hour. What
    the earlier slots of a key pass on is found from one row per key and slot.
    """
    entry = F.struct("created_at", "value", "expires_at")

    def micros(ts: str) -> Column:
        return F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")

    versions = cache.select("key", micros("created_at"), F.col("created_at").alias("_at"), entry.alias("_entry"), F.lit(1).alias("_kind"))
    asked = requests.withColumns({"_us": micros("req_ts"), "_at": F.col("req_ts"), "_kind": F.lit(2)})
    events = _adaptive_slots(asked.unionByName(versions, allowMissingColumns=True), slot_seconds * 1_000_000, slot_rows)

    per_slot = events.groupBy("key", "_slot").agg(F.max("_entry").alias("_entry"), F.max(F.col("_kind") == 2).alias("_asked"))
    earlier = Window.partitionBy("key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    handed_on = (
        per_slot.withColumn("_entry", F.last("_entry", ignorenulls=True).over(earlier))
        .where(F.col("_asked") & F.col("_entry").isNotNull())
        .select("key", "_slot", "_entry", F.lit(0).alias("_kind"))
    )
    timeline = events.unionByName(handed_on, allowMissingColumns=True)
    # Handed-on entries come first, versions before a request of the same time.
    so_far = (
        Window.partitionBy("key", "_slot")
        .orderBy(F.col("_at").asc_nulls_first(), "_kind", "_entry")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = timeline.withColumn("_found", F.last("_entry", ignorenulls=True).over(so_far)).where("_kind = 2")
    hit = is_live(F.col("_found.expires_at"), F.col("req_ts"))
    return answered.select(
        *requests.columns,
        hit.alias("hit"),
        F.when(hit, F.col("_found.value")).alias("value"),
        F.col("_found.created_at").alias("entry_created_at"),
    )


def cache_stats(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits, misses, entries found expired, number of keys and hit ratio: one row."""
    stale = ~F.col("hit") & F.col("entry_created_at").isNotNull()
    asked = lookups.agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.count_distinct(F.when(stale, F.struct("key", "entry_created_at"))).alias("items_expired"),
    )
    held = cache.agg(F.count_distinct("key").alias("item_count"))
    parts = asked.unionByName(held, allowMissingColumns=True)
    total = parts.agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "items_expired", "item_count")])
    return total.withColumn("hit_ratio", ratio(F.col("hits"), F.col("hits") + F.col("misses")))
