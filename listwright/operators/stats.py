"""Report statistics and rankings."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.config import PREVIEW_ROWS, SOCIAL_NETWORKS
from listwright.functions.text import is_filled, split_emails, to_numeric, url_host


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def contact_stats(df: DataFrame) -> DataFrame:
    """Statistics after exclusion, one row."""
    return contact_stats_by(df)


def contact_stats_by(df: DataFrame, *groups: str) -> DataFrame:
    """Statistics after exclusion, one row per group, in one pass over the table.

    Each listing becomes a row of measures and one for its site, its host and
    each of its addresses. Equal values meet once, combined before the shuffle;
    what is left are a group's different values, which are counted in a second,
    small step, so no value of any frequency and no group needs a task of its own.
    """
    values = _counted_values(df, *groups)
    once = values.groupBy(*groups, "_kind", "_value").agg(*[F.sum(c).alias(c) for c in MEASURES])
    found = once.groupBy(*groups).agg(
        _total("_listings", "companies"),
        F.count_if((F.col("_kind") == ADDRESS)).alias("unique_emails"),
        _total("_phone", "phones"),
        _total("_phone", "mobile_phones"),
        F.count_if(F.col("_kind") == SITE).alias("domains"),
        F.count_if(F.col("_kind") == HOST).alias("distinct_hosts"),
        _total("_social", "social_networks"),
    )
    return found


MEASURES = ["_listings", "_phone", "_social"]
LISTING, ADDRESS, SITE, HOST = 0, 1, 2, 3


def _total(measure: str, name: str) -> Column:
    return F.coalesce(F.sum(measure), F.lit(0)).alias(name)


def _counted_values(df: DataFrame, *groups: str) -> DataFrame:
    """Rows ``_kind, _value`` of all that is counted once per value, and a listing's measures in a row of their own."""
    has = set(df.columns)
    phone = F.col("phone").isNotNull() if "phone" in has else F.lit(False)
    website = F.col("website") if "website" in has else F.lit(None).cast("string")
    social = (
        reduce(add, [_flag(F.col(c).isNotNull()) for c in SOCIAL_NETWORKS])
        if has.issuperset(SOCIAL_NETWORKS)
        else F.lit(0)
    )
    nothing = F.lit(None).cast("string")

    def one(kind: int, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), value.alias("_value"), *[F.lit(0).alias(m) for m in MEASURES])

    listing = F.struct(
        F.lit(LISTING).alias("_kind"), nothing.alias("_value"), F.lit(1).alias("_listings"), _flag(phone).alias("_phone"), social.alias("_social")
    )
    addresses = F.transform(split_emails(F.col("email"), ","), lambda e: one(ADDRESS, e))
    own = F.array(listing, one(SITE, website), one(HOST, F.nullif(url_host(website), F.lit(""))))
    rows = df.select(*groups, F.explode(F.concat(own, addresses)).alias("_one")).select(*groups, "_one.*")
    return rows.where((F.col("_kind") == LISTING) | F.col("_value").isNotNull())


def contact_sketches(df: DataFrame, *groups: str, lg_config_k: int = 14) -> DataFrame:
    """What statistics need, in a form that merges: sums, and sketches of the different addresses, sites and hosts.

    One row per group, of some 30 kilobytes at most whatever the group's size. Store them
    per file or day; :func:`merged_contact_stats` gives the statistics of any
    union without the listings.
    """
    kinds = {"emails": ADDRESS, "sites": SITE, "hosts": HOST}
    return _counted_values(df, *groups).groupBy(*groups).agg(
        F.sum("_listings").alias("listings"), F.sum("_phone").alias("phones"), F.sum("_social").alias("social"),
        *[F.hll_sketch_agg(F.when(F.col("_kind") == k, F.col("_value")), lg_config_k).alias(n) for n, k in kinds.items()],
    )


def merged_contact_stats(sketches: DataFrame, *groups: str) -> DataFrame:
    """:func:`contact_stats_by` of everything that went into the sketches; distinct counts within about two per cent."""

    def distinct(sketch: str, name: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).alias(name)

    return sketches.groupBy(*groups).agg(
        _total("listings", "companies"), distinct("emails", "unique_emails"), _total("phones", "phones"), _total("phones", "mobile_phones"),
        distinct("sites", "domains"), distinct("hosts", "distinct_hosts"), _total("social", "social_networks"),
    )


def extraction_stats(df: DataFrame, nulls_as_present: bool = False) -> DataFrame:
    """Statistics after extraction, one row. A missing column counts 0.

    ``nulls_as_present`` counts missing cells too, as the original does.
    """

    def present(name: str) -> Column:
        if name not in df.columns:
            return F.lit(False)
        return is_filled(F.col(name)) | F.lit(nulls_as_present) & F.col(name).isNull()

    return df.agg(
        F.count("*").alias("companies"),
        F.count_if(present("website")).alias("domains"),
        F.count_if(present("email")).alias("valid_emails"),
        F.count_if(present("phone")).alias("phones"),
        reduce(add, [F.count_if(present(c)) for c in SOCIAL_NETWORKS]).alias("social_networks"),
    )


def sector_counts(df: DataFrame, sector: str = "main_category") -> DataFrame:
    """Companies per sector, most frequent first, ties by name."""
    return (
        df.where(F.col(sector).isNotNull())
        .groupBy(F.col(sector).alias("sector"))
        .agg(F.count("*").alias("number_of_companies"))
        .orderBy(F.desc("number_of_companies"), "sector")
    )


def top_sectors(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("number_of_companies"), "sector").limit(k)


def stats_long(stats: DataFrame) -> DataFrame:
    """One-row statistics as (metric, value) rows."""
    return stats.select(*[F.col(c).cast("bigint") for c in stats.columns]).unpivot(
        [], list(stats.columns), "metric", "value"
    )


def basic_stats(excluded: DataFrame) -> DataFrame:
    """Minimal long statistics over the output of an exclusion."""
    return stats_long(
        excluded.agg(
            F.count("*").alias("Total rows"),
            F.coalesce(F.sum("kept_count"), F.lit(0)).alias("Valid emails"),
            F.coalesce(F.sum(F.col("given_count") - F.col("kept_count")), F.lit(0)).alias("Excluded emails"),
        )
    )


def rows_per_file(df: DataFrame, source: str = "source_file") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("rows"))


def review_order(reviews: str = "reviews") -> Column:
    return to_numeric(F.col(reviews).cast("string")).desc_nulls_last()


def sort_by_reviews(df: DataFrame, ordinal: list[str], reviews: str = "reviews") -> DataFrame:
    """Most reviewed first, cells without a number last.

    The source order breaks ties; it also lets the range partitioner split a
    value shared by many rows.
    """
    return df.orderBy(review_order(reviews), *ordinal)


def top_rows(df: DataFrame, ordinal: list[str], k: int = PREVIEW_ROWS, reviews: str = "reviews") -> DataFrame:
    return sort_by_reviews(df, ordinal, reviews).limit(k)


def country_rollup(stats: DataFrame, images: DataFrame, country: str = "country") -> DataFrame:
    """Statistics of all country folders with the image that carries their name.

    ``stats`` has one row per country folder, ``images`` one per base name.
    """
    named = images.select(F.col("base_name").alias(country), F.col("image"))
    return stats.join(named, country, "left")


def stats_by(df: DataFrame, group: str) -> DataFrame:
    """Companies, addresses and phones per folder."""
    return df.groupBy(group).agg(
        F.count("*").alias("companies"),
        F.sum(F.size(split_emails(F.col("email")))).alias("emails"),
        F.count("phone").alias("phones"),
    )
