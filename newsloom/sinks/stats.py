"""Statistics and errors of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom import settings
from newsloom.schemas import ERRORS, RUN_STATS


def run_stats(items: DataFrame, cache: DataFrame, errors: DataFrame,
              max_cache: int = settings.CACHE_MAX_ENTRIES) -> DataFrame:
    """One row of counters: the cache is counted before trimming and after."""
    kept = items.agg(F.count("*").alias("articles_collected"))
    cached = cache.agg(F.count("*").alias("cache_entries"))
    failed = errors.agg(F.count("*").alias("errors"))
    return kept.crossJoin(cached).crossJoin(failed).withColumn(
        "cache_entries_kept", F.least(F.col("cache_entries"), F.lit(max_cache).cast("bigint"))
    )


def all_errors(*parts: DataFrame) -> DataFrame:
    """Errors of all stages in one table; a stage without urls has NULL there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c in ERRORS.fieldNames():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*ERRORS.fieldNames())


def timed(stats: DataFrame, seconds: float) -> DataFrame:
    """The counters with the time the run took."""
    return stats.withColumn("execution_time", F.lit(float(seconds))).select(*RUN_STATS.fieldNames())


def write_stats(stats: DataFrame, path: str, date: str) -> None:
    """The counters of a day's run; another run of the day replaces them."""
    stats.write.mode("overwrite").parquet(f"{path}/date={date}")


def write_errors(errors: DataFrame, path: str, date: str) -> None:
    """Errors are stored beside the snapshot of the day, not dropped; a run without errors leaves none of that day."""
    errors.write.mode("overwrite").parquet(f"{path}/date={date}")
