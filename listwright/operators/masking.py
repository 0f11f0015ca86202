"""Masked copies of contact tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.config import DATA_SHEET
from listwright.functions.masks import mask_email, mask_phone, mask_social, mask_vowels
from listwright.operators.schema import quoted


def column_roles(name: str, legacy_names: bool = False) -> set[str]:
    """What a column holds, judged by its name.

    Short markers (``x``, ``tel``) must stand as a word of their own, so ``tax``
    and ``hotel`` stay readable; ``legacy_names`` looks for them anywhere.
    """
    low = name.lower()
    words = re.split(r"[^a-z0-9]+", low)

    def has(*marks: str) -> bool:
        return any(m in (low if legacy_names or len(m) > 3 else words) for m in marks)

    roles = set()
    if has("email"):
        roles.add("email")
    if low == "address":
        roles.add("address")
    if has("phone", "tel"):
        roles.add("phone")
    if has("facebook", "instagram", "linkedin", "x", "twitter"):
        roles.add("social")
    return roles


def _as_text(df: DataFrame, legacy_names: bool) -> DataFrame:
    """Phone numbers that were read as numbers become text, or they would stay readable."""
    numbers = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.IntegralType, T.DecimalType)) and "phone" in column_roles(f.name, legacy_names)
    ]
    return df.select(*[quoted(c).cast("string").alias(c) if c in numbers else quoted(c) for c in df.columns])


def _text_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}


def mask_table(
    df: DataFrame, legacy_names: bool = False, legacy_email: bool = False, keep: list[str] = ()
) -> DataFrame:
    """Mask every contact column but those in ``keep``; the first role that fits decides."""
    df = _as_text(df, legacy_names)
    text = _text_columns(df) - set(keep)
    masks = {
        "email": lambda c: mask_email(c, legacy_email),
        "address": mask_vowels,
        "phone": mask_phone,
        "social": mask_social,
    }

    def masked(name: str) -> Column:
        roles = column_roles(name, legacy_names)
        for role in masks:
            if name in text and role in roles:
                return masks[role](quoted(name)).alias(name)
        return quoted(name)

    return df.select(*[masked(c) for c in df.columns])


def mask_sweep(
    df: DataFrame, legacy_names: bool = False, legacy_email: bool = False, keep: list[str] = ()
) -> DataFrame:
    """Mask contact columns where the cell looks the part, then sweep all other text.

    The sweep masks what looks like an address or a phone number in any column
    that is not of that kind, whatever its name. ``keep`` names columns such as
    row keys that stay as they are.
    """
    df = _as_text(df, legacy_names)
    text = _text_columns(df) - set(keep)
    first_address = next((c for c in df.columns if c.lower() == "address"), None)

    def by_role(name: str) -> Column:
        cell = quoted(name)
        if name not in text:
            return cell
        roles = column_roles(name, legacy_names)
        if name == first_address:
            cell = mask_vowels(cell)
        if "email" in roles:
            cell = F.when(F.contains(cell, F.lit("@")), mask_email(cell, legacy_email)).otherwise(cell)
        if "phone" in roles:
            cell = F.when(cell.rlike("[0-9]"), mask_phone(cell)).otherwise(cell)
        if "social" in roles:
            cell = F.when(F.contains(cell, F.lit("/")), mask_social(cell)).otherwise(cell)
        return cell.alias(name)

    def swept(name: str) -> Column:
        cell = quoted(name)
        if name not in text:
            return cell
        roles = column_roles(name, legacy_names)
        out = None
        if "email" not in roles:
            address = F.contains(cell, F.lit("@")) & F.contains(cell, F.lit("."))
            out = F.when(address, mask_email(cell, legacy_email))
        if "phone" not in roles:
            digits = F.length(F.regexp_replace(cell, "[^0-9]", ""))
            number = (F.length(cell) >= 7) & (digits >= 6)
            out = (F if out is None else out).when(number, mask_phone(cell))
        return cell if out is None else out.otherwise(cell).alias(name)

    return df.select(*[by_role(c) for c in df.columns]).select(*[swept(c) for c in df.columns])


def sweep_addresses(
    df: DataFrame, legacy_names: bool = False, legacy_email: bool = False, keep: list[str] = ()
) -> DataFrame:
    """Mask what looks like an address in text columns whose name tells nothing."""
    text = {c for c in _text_columns(df) - set(keep) if not column_roles(c, legacy_names)}

    def swept(name: str) -> Column:
        cell = quoted(name)
        if name not in text:
            return cell
        address = F.contains(cell, F.lit("@")) & F.contains(cell, F.lit("."))
        return F.when(address, mask_email(cell, legacy_email)).otherwise(cell).alias(name)

    return df.select(*[swept(c) for c in df.columns])


def mask_report(report: dict[str, DataFrame], **options) -> dict[str, DataFrame]:
    """Mask the data sheet, pass the others on. Without a data sheet nothing comes out."""
    if DATA_SHEET not in report:
        raise ValueError(f"report has no sheet '{DATA_SHEET}'")
    return {
        name: mask_sweep(sheet, **options) if name == DATA_SHEET else sheet
        for name, sheet in report.items()
    }
