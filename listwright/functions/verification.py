"""Address checks and the status ladder built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("basic", "advanced", "ultra")


def email_format_valid(email: Column) -> Column:
    return F.coalesce(email.rlike(r"^[^@]+@[^@]+\.[^@]+"), F.lit(False))


def verification_record(
    email: Column, domain_exists: Column, mx_exists: Column, mode: str = "advanced"
) -> Column:
    """Checks stop at the first that fails, so later flags stay false."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    well_formed = email_format_valid(email)
    probe = F.lit(mode != "basic")
    known = well_formed & probe & F.coalesce(domain_exists, F.lit(False))
    mail = known & F.coalesce(mx_exists, F.lit(False))
    return F.struct(
        email.alias("email"),
        well_formed.alias("format_valid"),
        known.alias("domain_exists"),
        mail.alias("mx_exists"),
        (mail & F.lit(mode == "ultra")).alias("smtp_verified"),
        F.lit(mode).alias("mode"),
    )


def verification_status(record: Column, mode: str = "advanced") -> Column:
    if mode == "basic":
        return F.when(record["format_valid"], "valid").otherwise("invalid")
    delivered = record["mx_exists"]
    if mode == "ultra":
        delivered = delivered & record["smtp_verified"]
    return (
        F.when(delivered, "valid")
        .when(record["format_valid"] & record["domain_exists"], "doubtful")
        .otherwise("invalid")
    )
