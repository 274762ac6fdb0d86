"""The content cache over one row per page."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import views as v
from newsloom.catalog.registered import register
from newsloom.operators import cache as ops
from newsloom.session import scratch_path
from newsloom.sinks.cache import write_cache
from newsloom.sources.cache import read_cache

_FRESH = f"fetched_at >= {v.SQL_AS_OF} - INTERVAL 14 DAY AND content_html <> ''"
_LIMIT = 100  # trim limit of the checks, so that trimming has an effect


def _us(c="fetched_at"):
    return F.unix_micros(F.col(c)).alias("fetched_us")


@register("cache_scan", f"""
{v.SQL_PAGE_CACHE}
SELECT url, content_html, epoch_us(fetched_at) AS fetched_us FROM cache""")
def cache_scan(spark, sf):
    """A stored cache read back, with a missing one beside it."""
    path = scratch_path(spark, "cache")
    v.content_cache(spark, sf).write.parquet(f"{path}/version=0")
    missing = read_cache(spark, scratch_path(spark, "no-cache"))
    return read_cache(spark, path).unionByName(missing).select("url", "content_html", _us())


@register("cache_fresh", f"{v.SQL_PAGE_CACHE} SELECT url, epoch_us(fetched_at) AS fetched_us FROM cache WHERE {_FRESH}")
def cache_fresh(spark, sf):
    return ops.fresh_cache(v.content_cache(spark, sf), v.AS_OF).select("url", _us())


@register("cache_hit_join", f"""
{v.SQL_PAGE_CACHE}, fresh AS (SELECT url, content_html FROM cache WHERE {_FRESH})
SELECT seq, url, content_html,
       CASE WHEN summary = '' AND content_html IS NOT NULL THEN substr({v.sql_joined_text('content_html')}, 1, 280)
            ELSE summary END AS summary
FROM readers LEFT JOIN fresh USING (url)""")
def cache_hit_join(spark, sf):
    hits = ops.cache_hits(v.cache_readers(spark, sf), v.content_cache(spark, sf), v.AS_OF)
    return hits.select("seq", "url", "content_html", "summary")


@register("cache_miss_anti", f"""
{v.SQL_PAGE_CACHE}
SELECT seq, url FROM readers WHERE url NOT IN (SELECT url FROM cache WHERE {_FRESH})""")
def cache_miss_anti(spark, sf):
    return ops.cache_misses(v.cache_readers(spark, sf), v.content_cache(spark, sf), v.AS_OF).select("seq", "url")


def new_content(spark, sf):
    """Content fetched in this run: some urls are cached already, some are not."""
    return v.page_items(spark, sf).selectExpr(
        "CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/new' END AS url", "'new ' || page_id AS content_html",
        f"timestamp '{v.AS_OF}Z' AS fetched_at",
    )


_SQL_UPSERT = f"""
{v.SQL_PAGE_CACHE},
fetched AS (SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/new' END AS url,
                   'new ' || page_id AS content_html, {v.SQL_AS_OF} AS fetched_at FROM page_items),
merged AS (SELECT * FROM fetched UNION ALL SELECT * FROM cache WHERE url NOT IN (SELECT url FROM fetched))"""
_SQL_TRIMMED = f"""
SELECT url, content_html, epoch_us(fetched_at) AS fetched_us FROM merged
ORDER BY fetched_at DESC NULLS LAST, url LIMIT {_LIMIT}"""


@register("cache_upsert", f"{_SQL_UPSERT} SELECT url, content_html, epoch_us(fetched_at) AS fetched_us FROM merged")
def cache_upsert(spark, sf):
    merged = ops.cache_upsert(v.content_cache(spark, sf), new_content(spark, sf))
    return merged.select("url", "content_html", _us())


@register("cache_trim", f"""
{v.SQL_PAGE_CACHE}
SELECT url, epoch_us(fetched_at) AS fetched_us FROM cache ORDER BY fetched_at DESC NULLS LAST, url LIMIT {_LIMIT}""")
def cache_trim(spark, sf):
    return ops.cache_trim(v.content_cache(spark, sf), _LIMIT).select("url", _us())


@register("cache_write", _SQL_UPSERT + _SQL_TRIMMED)
def cache_write(spark, sf):
    """Two versions written; the newest is read back."""
    path = scratch_path(spark, "cache")
    v.content_cache(spark, sf).write.parquet(f"{path}/version=0")
    write_cache(spark, path, new_content(spark, sf), _LIMIT)
    return read_cache(spark, path).select("url", "content_html", _us())


@register("cache_counts", f"""
{v.SQL_PAGE_CACHE}, fresh AS (SELECT url FROM cache WHERE {_FRESH})
SELECT count(*) FILTER (url IN (SELECT url FROM fresh)) AS cache_hits,
       count(*) FILTER (url NOT IN (SELECT url FROM fresh)) AS cache_misses,
       (SELECT count(*) FROM cache) AS cache_entries FROM readers""")
def cache_counts(spark, sf):
    return ops.cache_counts(v.cache_readers(spark, sf), v.content_cache(spark, sf), v.AS_OF)
