"""The source registry: which sources there are and how each is treated."""

from __future__ import annotations

import json
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from newsloom import settings
from newsloom.schemas import SOURCE_REGISTRY


def timezone_or_default(name: str | None) -> str:
    """The zone name if it is a known zone, else the default."""
    try:
        return ZoneInfo(name or settings.DEFAULT_TIMEZONE).key
    except Exception:
        return settings.DEFAULT_TIMEZONE


def _parse_config(text: str) -> dict:
    """JSON, or YAML where that library is installed."""
    try:
        return json.loads(text) or {}
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def _typed(entry: dict, field: T.StructField):
    """A configured value; numbers may be written as text."""
    value = entry.get(field.name)
    if value is None or isinstance(field.dataType, T.MapType):
        return value
    try:
        if isinstance(field.dataType, T.IntegerType):
            return int(value)
        if isinstance(field.dataType, T.ArrayType):
            return [int(v) for v in value]
    except (TypeError, ValueError):
        raise ValueError(f"source {entry.get('name')}: {field.name} is not a number: {value!r}") from None
    return str(value)


def registry_from_rows(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Configuration entries, in list order, as a table."""
    rows = []
    for ord_, entry in enumerate(sources):
        entry = dict(entry, headers={k: str(v) for k, v in (entry.get("headers") or {}).items()})
        rows.append((ord_, *(_typed(entry, f) for f in SOURCE_REGISTRY.fields[1:])))
    return spark.createDataFrame(rows, SOURCE_REGISTRY)


def read_sources(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(time zone, registry) from a configuration file, which is read once on the driver."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    config = _parse_config(text)
    return (
        timezone_or_default(config.get("timezone")),
        with_defaults(registry_from_rows(spark, config.get("sources") or [])),
    )


def with_defaults(registry: DataFrame) -> DataFrame:
    """Every NULL gets its default; a feed without its own timeout uses the source's; numbers may be text."""
    number = lambda name, default: F.coalesce(F.col(name).cast("int"), default)
    timeout = number("timeout", F.lit(settings.FETCH_TIMEOUT))
    return registry.withColumns({
        "name": F.coalesce("name", F.lit(settings.DEFAULT_SOURCE_NAME)),
        "timeout": timeout,
        "feed_timeout": number("feed_timeout", timeout),
        "headers": F.coalesce("headers", F.create_map().cast("map<string,string>")),
        "recent_hours": number("recent_hours", F.lit(settings.DEFAULT_RECENT_HOURS)),
        "min_keep": number("min_keep", F.lit(settings.DEFAULT_MIN_KEEP)),
        "fallback_statuses": F.coalesce("fallback_statuses", F.array().cast("array<int>")),
    })


def policies(registry: DataFrame) -> DataFrame:
    """One policy per name: of entries with the same name the last one wins."""
    last = Window.partitionBy("name").orderBy(F.col("source_ord").desc())
    return (
        with_defaults(registry)
        .withColumn("_rn", F.row_number().over(last))
        .where(F.col("_rn") == 1)
        .select(F.col("name").alias("source"), "recent_hours", "min_keep")
    )
