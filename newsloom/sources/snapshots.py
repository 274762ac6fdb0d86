"""Published snapshots read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.schemas import ENVELOPE
from newsloom.sinks.pointer import read_table
from newsloom.sources.partitions import partition_values


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents, one row each."""
    return spark.read.schema(ENVELOPE).json(path, multiLine=True)


def snapshot_items(envelopes: DataFrame) -> DataFrame:
    """Items of the snapshots; a document without an item list has none."""
    return envelopes.select("date", F.explode("items").alias("i")).select("date", "i.*")


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """All days; a filter on date prunes the scan."""
    return spark.read.parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last run that was published whole."""
    return read_table(spark, path)


def latest_view(daily: DataFrame) -> DataFrame:
    """Rows of the newest day that was run, none if it had none; `daily` is a stored table."""
    days = partition_values(daily, "date")
    return daily.where(F.col("date").cast("string") == F.lit(days[-1] if days else None))
