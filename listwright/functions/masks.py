"""Masking expressions for contact data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions.text import split_emails


def mask_address(email: Column, min_masked: int = 0) -> Column:
    """First character of the local part, stars for the rest, the domain as it is.

    The local part ends at the first ``@``. With ``min_masked`` a local part too
    short to hide that many characters is starred completely.
    """
    at = F.instr(email, "@")
    shown = F.when(at - 2 < min_masked, F.lit(0)).otherwise(F.lit(1))
    masked = F.concat(
        F.substr(email, F.lit(1), shown),
        F.repeat(F.lit("*"), at - 1 - shown),
        F.substr(email, at),
    )
    return F.when(at > 1, masked).otherwise(email)


def mask_email(cell: Column, legacy: bool = False, min_masked: int = 0) -> Column:
    """Mask every address of a cell; ``legacy`` masks only the first one."""
    if legacy:
        return mask_address(cell, min_masked)
    masked = F.array_join(
        F.transform(split_emails(cell), lambda e: mask_address(e, min_masked)), ", "
    )
    return F.when(F.contains(cell, F.lit("@")), masked).otherwise(cell)


def mask_phone(phone: Column) -> Column:
    return F.when(
        F.length(phone) > 2, F.concat(F.substr(phone, F.lit(1), F.length(phone) - 2), F.lit("**"))
    ).when(phone.isNotNull(), F.lit("**"))


def mask_social(url: Column) -> Column:
    return F.concat(F.left(F.substring_index(url, "/", -1), F.lit(2)), F.lit("****"))


def mask_vowels(text: Column) -> Column:
    return F.translate(text, "aeiouAEIOU", "**********")
