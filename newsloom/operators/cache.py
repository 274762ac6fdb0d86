"""The content cache: freshness, hits, misses, upsert, trim."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsloom import settings
from newsloom.functions.dates import instant
from newsloom.functions.text import summary_backfill


def fresh_cache(cache: DataFrame, as_of, days: int = settings.CACHE_STALE_DAYS) -> DataFrame:
    """Rows young enough to be used (bound included); empty content counts as absent."""
    oldest = instant(as_of) - F.make_dt_interval(F.lit(days))
    return cache.where((F.col("fetched_at") >= oldest) & (F.col("content_html") != ""))


def cache_hits(items: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    """All items, with cached content and a summary taken from it where one is lacking.

    Both sides have one row per url, so no key is hot.
    """
    fresh = fresh_cache(cache, as_of).select("url", "content_html")
    return (
        items.drop("content_html")
        .join(fresh, "url", "left")
        .withColumn("summary", summary_backfill(F.col("summary"), F.col("content_html")))
    )


def cache_misses(items: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    """Items without usable cached content."""
    return items.join(fresh_cache(cache, as_of).select("url"), "url", "left_anti")


def cache_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old rows of the same url; the later of two new rows wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy("url").orderBy(
        F.col("_new").desc(), F.col("fetched_at").desc_nulls_last(), F.col("content_html")
    )
    return both.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") == 1).drop("_rn", "_new")


def cache_trim(cache: DataFrame, limit: int | None = settings.CACHE_MAX_ENTRIES) -> DataFrame:
    """Newest rows only; a cache within the limit, or without one, is unchanged."""
    if limit is None:
        return cache
    return cache.orderBy(F.col("fetched_at").desc_nulls_last(), "url").limit(limit)


def cache_counts(items: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    """One row: hits, misses and cache size."""
    fresh = fresh_cache(cache, as_of).select("url", F.lit(True).alias("_hit"))
    marked = items.join(fresh, "url", "left")
    counts = marked.agg(
        F.count_if(F.col("_hit").isNotNull()).alias("cache_hits"),
        F.count_if(F.col("_hit").isNull()).alias("cache_misses"),
    )
    return counts.crossJoin(cache.agg(F.count("*").alias("cache_entries")))
