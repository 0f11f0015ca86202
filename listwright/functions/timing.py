"""Durations, ages, expiry times and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.config import CACHE_TTL_SECONDS

_BITS = 1 << 58


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded as Python's ``.1f`` does for values >= 0.

    The binary fraction is scaled to an integer, so ties are exact and go to the
    even digit; ``format_string`` would round the printed digits half up.
    """
    value = value.cast("double")
    whole = F.floor(value)
    scaled = ((value - whole) * F.lit(float(_BITS))).cast("bigint") * 10
    digit = F.shiftright(scaled, 58)
    rest = scaled - digit * F.lit(_BITS)
    half = F.lit(_BITS // 2)
    up = F.when((rest > half) | ((rest == half) & (digit % 2 == 1)), 1).otherwise(0)
    tenths = whole * 10 + digit + up
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")
    )


def format_duration(seconds: Column) -> Column:
    def by_size(second: object, minute: object, hour: object) -> Column:
        return F.when(seconds < 60, second).when(seconds < 3600, minute).otherwise(hour)

    return F.concat(one_decimal(seconds / by_size(1.0, 60.0, 3600.0)), by_size("s", "m", "h"))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with fractions."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def expiry(created_at: Column, ttl_seconds: Column, default: int = CACHE_TTL_SECONDS) -> Column:
    """Creation plus lifetime; a missing or zero lifetime means the default."""
    ttl = F.coalesce(F.nullif(ttl_seconds, F.lit(0)), F.lit(default))
    return created_at + F.make_dt_interval(secs=ttl)


def is_live(expires_at: Column, at: Column) -> Column:
    return F.coalesce(expires_at > at, F.lit(False))


def age_days(mtime: Column, at: Column) -> Column:
    return seconds_between(mtime, at) / 86400


def ratio(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def eta_seconds(total: Column, processed: Column, per_second: Column) -> Column:
    """Remaining seconds at the current speed; 0 when nothing can be said."""
    return F.when((per_second > 0) & (total > 0), (total - processed) / per_second).otherwise(F.lit(0.0))
