"""Error classes: which are temporary and how they are reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.config import (
    CONNECTION_ERROR_TYPES,
    DOM_ERROR_TYPES,
    DRIVER_ERROR_TYPES,
    NETWORK_ERROR_CODES,
    TRANSIENT_TERMS,
)


def is_retriable(error_type: Column, message: Column) -> Column:
    transient = F.lower(message).rlike("|".join(TRANSIENT_TERMS))
    retriable = error_type.isin(CONNECTION_ERROR_TYPES) | (
        error_type.isin(DRIVER_ERROR_TYPES) & transient
    )
    return F.coalesce(retriable, F.lit(False))


def error_category(error_type: Column, message: Column) -> Column:
    network = error_type.isin(CONNECTION_ERROR_TYPES) | message.rlike("|".join(NETWORK_ERROR_CODES))
    return (
        F.when(network, "NETWORK")
        .when(error_type.isin(DOM_ERROR_TYPES), "DOM")
        .otherwise("GENERAL")
    )


def error_severity(category: Column) -> Column:
    return (
        F.when(category == "NETWORK", "warning").when(category == "DOM", "info").otherwise("error")
    )


def error_line(category: Column, error_type: Column, message: Column, url: Column, operation: Column) -> Column:
    """The text written to a log for one error."""
    missing = F.lit("N/A")
    return F.concat(
        F.lit("["), category, F.lit("] "), error_type, F.lit(": "), F.coalesce(message, F.lit("")),
        F.lit(" | URL: "), F.coalesce(url, missing),
        F.lit(" | Operation: "), F.coalesce(operation, missing),
    )
