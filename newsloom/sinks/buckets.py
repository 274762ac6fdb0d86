"""Tables by url hash, such as the content cache: a merge rewrites only the buckets that it touches.

A bucket is a folder of its own, written anew by each merge that has a url in
it.  The manifest (`sinks.pointer`) names the present folder of every bucket
and the last batch of every stream, so a reader sees whole merges only, and a
batch that is repeated changes nothing.  The work of a merge follows the
touched buckets: with many more buckets than urls in a batch, it does not
follow the table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsloom.operators.cache import cache_upsert
from newsloom.schemas import CONTENT_CACHE
from newsloom.session import remove_path
from newsloom.sinks.pointer import forget, manifests, point_to, read_manifest

BUCKETS = 256  # of a new table; a stored one keeps its number


def bucket_of(url: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n)).cast("int")


def _rows(spark: SparkSession, path: str, folders, schema: T.StructType) -> DataFrame:
    paths = [f"{path}/{f}" for f in sorted(folders)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched_buckets(new: DataFrame, n: int) -> list[int]:
    """The buckets of a batch: at most n numbers."""
    return sorted(r["bucket"] for r in new.select(bucket_of(F.col("url"), n).alias("bucket")).distinct().collect())


def read_buckets(spark: SparkSession, path: str, schema: T.StructType = CONTENT_CACHE,
                 like: DataFrame | None = None) -> DataFrame:
    """All rows as last published, or those of the buckets that the urls of `like` fall in.

    A table that is not there yet is empty.
    """
    manifest = read_manifest(spark, path)
    if manifest is None:
        return spark.createDataFrame([], schema)
    named = manifest["buckets"]
    if like is not None:
        named = {k: f for k, f in named.items() if int(k) in set(touched_buckets(like, manifest["n"]))}
    return _rows(spark, path, named.values(), schema)


def merge_buckets(new: DataFrame, path: str, stream: str = "", batch: int | None = None, buckets: int = BUCKETS,
                  keep: int = 2, schema: T.StructType = CONTENT_CACHE, combine=cache_upsert) -> list[int]:
    """Merge new rows into the table; returns the buckets that were rewritten.

    `combine(old, new)` makes one row per url; for the cache, new rows replace
    old ones.  A batch of a stream that is published already is left out.  The
    folders of the newest `keep` merges stay for readers that have begun; what
    a merge that died has written is never read.
    """
    spark, new = new.sparkSession, new.select(*schema.names)
    manifest = read_manifest(spark, path) or {"n": buckets, "buckets": {}, "batches": {}}
    n, known, batches = manifest["n"], manifest["buckets"], manifest["batches"]
    if batch is not None and batch <= batches.get(stream, -1):
        return []
    touched = touched_buckets(new, n)
    if not touched:
        return []
    number = (manifests(spark, path) or [-1])[-1] + 1
    folder = f"m-{number:012d}-" + hashlib.sha1(f"{stream}:{batch}".encode()).hexdigest()[:12]
    old = _rows(spark, path, (known[str(b)] for b in touched if str(b) in known), schema)
    merged = combine(old, new).withColumn("bucket", bucket_of(F.col("url"), n))
    # one task and one file for a bucket; each holds 1/n of the urls
    merged.repartition("bucket").sortWithinPartitions("bucket", "url").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{path}/{folder}")
    now = known | {str(b): f"{folder}/bucket={b}" for b in touched}
    seen = batches if batch is None else batches | {stream: batch}
    point_to(spark, path, folder, n=n, buckets=now, batches=seen)
    _drop_unnamed(spark, path, keep)
    return touched


def _drop_unnamed(spark: SparkSession, path: str, keep: int) -> None:
    """Forget all but the newest manifests, then remove the buckets that none of those names."""
    numbers = manifests(spark, path)
    kept = {f for k in numbers[-keep:] for f in read_manifest(spark, path, k)["buckets"].values()}
    for number in numbers[:-keep]:
        gone = set(read_manifest(spark, path, number)["buckets"].values()) - kept
        forget(spark, path, number)
        for folder in sorted(gone):
            remove_path(spark, f"{path}/{folder}")
