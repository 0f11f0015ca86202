"""Checking addresses against a table of domain facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import email_domain
from listwright.functions.verification import verification_record, verification_status
from listwright.operators.skew import skew_join


def verify_emails(emails: DataFrame, domains: DataFrame, mode: str = "advanced") -> DataFrame:
    """Add the verification record and its status to rows with an ``email``.

    ``domains(domain, domain_exists, mx_exists)`` has one row per domain. Mode
    ``basic`` looks at the address alone and joins nothing.
    """
    keyed = emails.withColumn("_domain", email_domain(F.col("email")))
    facts = domains.select(
        F.col("domain").alias("_domain"),
        F.col("domain_exists").alias("_exists"),
        F.col("mx_exists").alias("_mx"),
    )
    if mode == "basic":
        nothing = F.lit(None).cast("boolean")
        joined = keyed.withColumn("_exists", nothing).withColumn("_mx", nothing)
    else:
        joined = skew_join(keyed, facts, "_domain")
    record = verification_record(F.col("email"), F.col("_exists"), F.col("_mx"), mode)
    return (
        joined.withColumn("_record", record)
        .select(
            *emails.columns,
            *[
                F.col("_record")[f].alias(f)
                for f in ("format_valid", "domain_exists", "mx_exists", "smtp_verified", "mode")
            ],
            verification_status(F.col("_record"), mode).alias("status"),
        )
    )
