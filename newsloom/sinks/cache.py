"""Writing the content cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom import settings
from newsloom.operators.cache import cache_trim, cache_upsert
from newsloom.session import remove_path
from newsloom.sources.cache import cache_versions, latest_version, read_cache


def write_cache(spark: SparkSession, path: str, new: DataFrame, limit: int | None = settings.CACHE_MAX_ENTRIES,
                version: int | None = None, base: DataFrame | None = None) -> int:
    """Merge new content into the cache as a new version; returns its number.

    `base` stands in for the stored version, where that cannot be read.
    The version that is read is never overwritten.  Writing the same version
    again (a repeated micro-batch) replaces it with the same rows.
    """
    if version is None:
        newest = latest_version(spark, path)
        version = 0 if newest is None else newest + 1
    stored = read_cache(spark, path, before=version) if base is None else base
    merged = cache_upsert(stored, new.select("url", "content_html", "fetched_at"))
    # one directory per version, replaced as a whole when a batch is repeated
    cache_trim(merged, limit).write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest versions; readers of the last one are not disturbed."""
    for version in cache_versions(spark, path)[:-keep]:
        remove_path(spark, f"{path}/version={version}")
