"""Counts shown to operators and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.operators.skew import distributed_rank, lookup_join


def per_source_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("n"))


def distinct_sources(items: DataFrame) -> DataFrame:
    """Sources in ascending order."""
    return items.select("source").distinct().orderBy("source")


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("source").agg(F.count("*").alias("n"))


def headline(items: DataFrame, generated_at) -> DataFrame:
    """Number of items shown and the time of generation."""
    return items.agg(F.count("*").alias("n")).withColumn("generated_at", generated_at)


def items_by_source(items: DataFrame) -> DataFrame:
    """Position of each item in its source's list, in arrival order.

    A global distributed rank over (source, arrival) minus the rank at which the
    source starts: a source with a third of the items is still split over tasks.
    """
    ranked = distributed_rank(items, [F.col("source"), F.col("seq")], "_rank")
    starts = ranked.groupBy("source").agg(F.min("_rank").alias("_start"))
    return (
        lookup_join(ranked, starts, "source", spread="seq", how="inner")
        .withColumn("pos", F.col("_rank") - F.col("_start") + 1)
        .drop("_rank", "_start")
    )
