"""Column operators. They look at names only and start no job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.config import (
    COLUMN_ORDER,
    DROP_COLUMNS,
    HEADER_SYNONYMS,
    PREVIEW_CHARS,
    PREVIEW_COLUMNS,
    PREVIEW_ROWS,
    RENAME_COLUMNS,
    SAMPLE_ROWS,
)
from listwright.functions.text import truncate_text


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def canonicalize_columns(df: DataFrame, synonyms: dict[str, str] = HEADER_SYNONYMS) -> DataFrame:
    """Rename header synonyms; several sources of one name are coalesced in header order."""
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(df.columns):
        groups.setdefault(synonyms.get(name, name), []).append(i)
    positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return positional.select(
        *[F.coalesce(*[F.col(f"_c{i}") for i in members]).alias(name) for name, members in groups.items()]
    )


def ensure_column(df: DataFrame, name: str, default: str | None = None) -> DataFrame:
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default).cast("string"))


def drop_columns(df: DataFrame, names: list[str] = DROP_COLUMNS) -> tuple[DataFrame, int]:
    present = [c for c in dict.fromkeys(names) if c in df.columns]
    return df.select(*[quoted(c) for c in df.columns if c not in present]), len(present)


def rename_columns(df: DataFrame, names: dict[str, str] = RENAME_COLUMNS) -> tuple[DataFrame, int]:
    """Rename present columns in the order given, so one rename can feed the next."""
    columns = list(df.columns)
    done = 0
    for old, new in names.items():
        if old in columns:
            columns = [new if c == old else c for c in columns]
            done += 1
    return df.toDF(*columns), done


def reorder_columns(df: DataFrame, order: list[str] = COLUMN_ORDER) -> tuple[DataFrame, int]:
    """Listed columns first, the others after them as they were."""
    first = [c for c in dict.fromkeys(order) if c in df.columns]
    rest = [c for c in df.columns if c not in first]
    return (df.select(*[quoted(c) for c in first + rest]) if first else df), len(first)


def clean_frame(
    df: DataFrame,
    drop: list[str] = DROP_COLUMNS,
    rename: dict[str, str] = RENAME_COLUMNS,
    order: list[str] = COLUMN_ORDER,
) -> tuple[DataFrame, dict[str, int]]:
    """Drop, rename, reorder; the counts come from the schema."""
    df, dropped = drop_columns(df, drop)
    df, renamed = rename_columns(df, rename)
    df, reordered = reorder_columns(df, order)
    return df, {"dropped": dropped, "renamed": renamed, "reordered": reordered}


def sample_head(df: DataFrame, order: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """First rows in source order."""
    return df.orderBy(*order).limit(rows)


def preview(
    df: DataFrame,
    order: list[str],
    columns: list[str] | None = None,
    null_text: str = "nan",
    rows: int = PREVIEW_ROWS,
) -> DataFrame:
    """The small text table shown in reports."""
    shown = (columns or [c for c in df.columns])[:PREVIEW_COLUMNS]
    top = df.orderBy(*order).limit(rows)
    return top.select(
        *[
            truncate_text(F.coalesce(quoted(c).cast("string"), F.lit(null_text)), PREVIEW_CHARS).alias(c)
            for c in shown
        ]
    )


def pick_sector_columns(
    df: DataFrame, labels: tuple[str, str] = ("Sector", "Number of companies")
) -> DataFrame | None:
    """Sector and count column of a table by name, or of any two-column table."""
    sectors = [c for c in df.columns if "sector" in c.lower()]
    counts = [c for c in df.columns if "number" in c.lower() or "count" in c.lower()]
    if not sectors and len(df.columns) == 2:
        sectors, counts = df.columns[:1], df.columns[1:]
    if not (sectors and counts):
        return None
    return df.select(quoted(sectors[0]).alias(labels[0]), quoted(counts[0]).alias(labels[1]))
