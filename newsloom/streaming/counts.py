"""Items per source and day, continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.session import read_or_empty

_SEALED = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("n", T.LongType()), T.StructField("day", T.DateType()),
])


def daily_counts(items: DataFrame, late: str = "14 days") -> DataFrame:
    """Batch or stream: items per source and UTC day of publication.

    On a stream the watermark bounds the state (days before it are closed), as
    only changed counts are put out; on a batch it has no effect.
    """
    return (
        items.where(F.col("published_at").isNotNull())
        .withWatermark("published_at", late)
        .groupBy(F.window("published_at", "1 day").alias("day"), "source")
        .agg(F.count("*").alias("n"))
        .select(F.col("day.start").alias("day"), "source", "n")
    )


def stream_daily_counts(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts that a trigger changed, as a folder per batch; a repeated batch rewrites its own."""
    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        daily_counts(items).writeStream.foreachBatch(changed).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts so far: the newest of each source and day."""
    changes = spark.read.parquet(path)
    return changes.groupBy("day", "source").agg(F.max_by("n", "batch").alias("n"))


def stream_sealed_days(items: DataFrame, path: str, checkpoint: str, late: str = "14 days") -> StreamingQuery:
    """Each day once, when the watermark has passed it: a folder and one file per day, one row per source.

    All sources of a day are sealed by the same batch, so a repeated batch
    replaces whole days.  Rows that come later than `late` are not counted.
    """
    def seal(batch: DataFrame, batch_id: int) -> None:
        # the folder's name is the day in UTC, whatever the session's zone
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("day") / 86400).cast("int"))
        batch.select("source", "n", day.alias("day")).repartition("day").sortWithinPartitions("day", "source").write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return (
        daily_counts(items, late).writeStream.foreachBatch(seal).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_sealed_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, source, n) of the sealed days, one row each; nothing is aggregated again."""
    rows = read_or_empty(spark, path, _SEALED)
    return rows.select(F.timestamp_seconds(F.unix_date("day").cast("bigint") * 86400).alias("day"), "source", "n")


def open_days(items: DataFrame, sealed: DataFrame) -> DataFrame:
    """(day, source, n) of the days after the last sealed one, counted from the items."""
    closed = sealed.agg((F.max("day") + F.make_dt_interval(F.lit(1))).alias("_closed"))
    # one row on the other side: sealed days are left out before anything is counted
    late = items.join(F.broadcast(closed), F.col("_closed").isNull() | (F.col("published_at") >= F.col("_closed")))
    return daily_counts(late.drop("_closed"))
