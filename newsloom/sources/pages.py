"""Landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.session import spread


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page table: page_id, url, html."""
    return spread(spark.read.parquet(path).select("page_id", "url", "html"), "page_id")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file; the file path is the page's key."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page_id"), F.col("value").alias("html")
    )
