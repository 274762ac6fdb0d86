"""The stored content cache: one partition per version, the newest one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsloom.schemas import CONTENT_CACHE, ERRORS
from newsloom.session import read_or_empty
from newsloom.sources.partitions import partition_values

_STORED = T.StructType([*CONTENT_CACHE.fields, T.StructField("version", T.LongType())])


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, _STORED)


def cache_versions(spark: SparkSession, path: str) -> list[int]:
    """Stored versions, oldest first, from the partition names."""
    return sorted(int(v) for v in partition_values(_stored(spark, path), "version"))


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """Newest stored version (below `before`)."""
    return max((v for v in cache_versions(spark, path) if before is None or v < before), default=None)


def read_cache(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest version; a missing cache is an empty one, a damaged one fails the job that reads it."""
    version = latest_version(spark, path, before)
    rows = _stored(spark, path)
    # a constant version prunes the scan to one partition
    return rows.where(F.col("version") == F.lit(version).cast("bigint")).drop("version")


def sound_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The newest version and no error; if it cannot be read whole, an empty cache and one error row.

    The check reads every column of the version once.
    """
    rows, reason = read_cache(spark, path), None
    try:
        rows.agg(F.sum(F.xxhash64(*rows.columns) % 1000)).collect()
    except Exception as e:
        # only what the data does counts; a session that is gone fails again below
        reason = f"{type(e).__name__}: cache starts empty, {path} cannot be read"
        rows = spark.createDataFrame([], CONTENT_CACHE)
    errors = [(None, path, reason)] if reason else []
    return rows, spark.createDataFrame(errors, ERRORS)
