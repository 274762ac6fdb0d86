"""Extracted content into the cache, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom import settings
from newsloom.session import read_or_empty
from newsloom.sinks.buckets import BUCKETS, merge_buckets
from newsloom.sinks.cache import drop_old_versions, write_cache
from newsloom.sources.cache import latest_version

_BATCHES = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("version", T.LongType()),
])


def _version_of(spark, path: str, stream: str, batch_id: int) -> int:
    """The version that a batch of a stream writes: its own if it was begun before, else the next."""
    log = f"{path}/_batches"  # folders that begin so are not data
    begun = read_or_empty(spark, log, _BATCHES).where((F.col("stream") == stream) & (F.col("batch") == batch_id))
    known = begun.agg(F.max("version").alias("v")).first()["v"]
    if known is not None:
        return known
    newest = latest_version(spark, path)
    version = 0 if newest is None else newest + 1
    spark.createDataFrame([(stream, batch_id, version)], _BATCHES).write.mode("append").parquet(log)
    return version


def stream_cache_upsert(content: DataFrame, cache_path: str, checkpoint: str,
                        limit: int | None = settings.CACHE_MAX_ENTRIES, keep: int = 2) -> StreamingQuery:
    """One cache version per micro-batch, after all that there are; a repeated batch rewrites its own.

    Versions before the last `keep` are removed.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = _version_of(spark, cache_path, checkpoint, batch_id)
        write_cache(spark, cache_path, batch, limit, version=version)
        drop_old_versions(spark, cache_path, keep)

    return (
        content.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_cache_buckets(content: DataFrame, cache_path: str, checkpoint: str, buckets: int = BUCKETS,
                         keep: int = 2) -> StreamingQuery:
    """Content into the cache by url hash: a micro-batch rewrites the buckets of its urls only.

    The form for a large cache; it has no limit on rows, readers trim (`cache_trim`).
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(batch, cache_path, checkpoint, batch_id, buckets, keep)

    return (
        content.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
