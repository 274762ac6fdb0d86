"""Fixed schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

ITEMS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("summary", T.StringType(), False),
    T.StructField("published_at", T.TimestampType(), True),
    T.StructField("content_html", T.StringType(), True),
])

SOURCE_REGISTRY = T.StructType([
    T.StructField("source_ord", T.LongType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("feed", T.StringType(), True),
    T.StructField("homepage", T.StringType(), True),
    T.StructField("selector", T.StringType(), True),
    T.StructField("timeout", T.IntegerType(), True),
    T.StructField("feed_timeout", T.IntegerType(), True),
    T.StructField("user_agent", T.StringType(), True),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("recent_hours", T.IntegerType(), True),
    T.StructField("min_keep", T.IntegerType(), True),
    # statuses of the explicit feed that allow the homepage to stand in for it
    T.StructField("fallback_statuses", T.ArrayType(T.IntegerType()), True),
])

CONTENT_CACHE = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("content_html", T.StringType(), True),
    T.StructField("fetched_at", T.TimestampType(), True),
])

ROBOTS_RULES = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("agent", T.StringType(), False),
    T.StructField("group_ord", T.IntegerType(), False),  # position of the group in the file
    T.StructField("rule_ord", T.IntegerType(), False),   # position in the group
    T.StructField("allow", T.BooleanType(), False),
    T.StructField("path_prefix", T.StringType(), False),
])

LANDED_RESPONSES = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("strategy", T.StringType(), False),  # feed | homepage | discovered
    T.StructField("url", T.StringType(), True),
    T.StructField("status", T.IntegerType(), True),    # NULL: no response
    T.StructField("body", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

ERRORS = T.StructType([
    T.StructField("source", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

_SNAPSHOT_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("content_html", T.StringType()),
])

ENVELOPE = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("items", T.ArrayType(_SNAPSHOT_ITEM)),
    T.StructField("errors", T.ArrayType(ERRORS)),
])

RUN_STATS = T.StructType([
    T.StructField("articles_collected", T.LongType()),
    T.StructField("cache_entries", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("cache_entries_kept", T.LongType()),
    T.StructField("execution_time", T.DoubleType()),  # seconds
])
