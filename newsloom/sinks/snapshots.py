"""Writing snapshots: the daily table, the latest rows, the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom import settings
from newsloom.functions.dates import instant, run_date, to_iso
from newsloom.sinks.pointer import replace_table

ITEM_COLUMNS = ("rank", "title", "url", "summary", "published_at", "source", "content_html")


def day_of(spark: SparkSession, as_of, zone: str = settings.DEFAULT_TIMEZONE) -> str:
    """The run's date as a partition name."""
    return spark.range(1).select(run_date(as_of, zone).alias("d")).first()["d"]


def write_daily(items: DataFrame, path: str, as_of, zone: str = settings.DEFAULT_TIMEZONE) -> None:
    """Write the run's items under the run's date; only that day is replaced, also by a run without items."""
    day = day_of(items.sparkSession, as_of, zone)
    items.select(*ITEM_COLUMNS).write.mode("overwrite").parquet(f"{path}/date={day}")


def write_latest(items: DataFrame, path: str, as_of, zone: str = settings.DEFAULT_TIMEZONE) -> None:
    """The same rows under a fixed name, replaced by every run once they are whole; `sources.snapshots.read_latest` reads them."""
    replace_table(items.select(*ITEM_COLUMNS).withColumn("date", run_date(as_of, zone)), path)


def _item_json(zone: str) -> Column:
    """One item; an undated item keeps its null date, absent content has no key."""
    fields = [
        "title", "url", "summary", to_iso(F.col("published_at"), zone).alias("published_at"), "source",
    ]
    nulls = {"ignoreNullFields": "false"}
    return F.when(
        F.col("content_html").isNull(), F.to_json(F.struct(*fields), nulls)
    ).otherwise(F.to_json(F.struct(*fields, "content_html"), nulls))


def envelope(items: DataFrame, errors: DataFrame, as_of, zone: str = settings.DEFAULT_TIMEZONE) -> DataFrame:
    """The snapshot document as one row; `items` are the capped, ranked items of a run."""
    listed = items.select("rank", _item_json(zone).alias("json")).agg(
        F.count("*").alias("count"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "json"))), lambda x: x["json"]), ","
        ).alias("items"),
    )
    error = F.to_json(F.struct("source", "url", "error"))
    failed = errors.agg(
        F.count("*").alias("n_errors"), F.array_join(F.array_sort(F.collect_list(error)), ",").alias("errors")
    )
    return listed.crossJoin(failed).select(
        run_date(as_of, zone).alias("date"), F.lit(zone).alias("timezone"),
        to_iso(instant(as_of), zone).alias("generated_at"), "count", "items", "n_errors", "errors",
    )


def envelope_json(document: DataFrame) -> DataFrame:
    """The document of `envelope` as JSON text."""
    head = F.to_json(F.struct("date", "timezone", "generated_at", "count"))
    return document.select(
        F.concat(
            F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"items":['), F.col("items"),
            F.lit('],"errors":['), F.col("errors"), F.lit("]}"),
        ).alias("value")
    )


def write_envelope(document: DataFrame, path: str) -> None:
    envelope_json(document).coalesce(1).write.mode("overwrite").text(path)
