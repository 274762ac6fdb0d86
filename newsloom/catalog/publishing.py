"""Snapshots, RSS, statistics and errors, written and read back."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from newsloom.catalog import acquisition as a, caches, views as v
from newsloom.catalog.pages import merged, SQL_FETCH_ERRORS, UNREADABLE, UNREADABLE_ERROR
from newsloom.catalog.registered import register
from newsloom.catalog.selection import chosen
from newsloom.operators.acquire import acquire
from newsloom.operators.cache import cache_upsert
from newsloom.operators.counts import per_source_counts
from newsloom.plans.daily import daily_run, publish, Published
from newsloom.plans.reader import find
from newsloom.session import scratch_path
from newsloom.sinks import rss, snapshots, stats
from newsloom.sources import snapshots as read
from newsloom.sources.cache import read_cache

_FIRST, _EARLIER = "2024-01-29 00:00:00", "2024-01-30 00:00:00"
_CHANNEL = rss.Channel("Daily & more", "https://news.example.org/", "What the day brought")
_SQL_TOP = f"{v.SQL_SELECTION}, top AS (SELECT * FROM ranked WHERE rank <= 120)"


def with_content(items):
    """A third of the items carry content."""
    return items.withColumn(
        "content_html", F.expr("CASE WHEN seq % 3 = 1 THEN '<p class=\"x\">' || title || ' & é</p>' END")
    )


_SQL_HTML = "CASE WHEN seq % 3 = 1 THEN '<p class=\"x\">' || title || ' & é</p>' END"


def published(spark, sf):
    """Three days written: the first replaced by a run without items, the last by another run."""
    path = scratch_path(spark, "daily")
    top = with_content(chosen(spark, sf))
    snapshots.write_daily(top, path, _FIRST, v.ZONE)
    snapshots.write_daily(top.limit(0), path, _FIRST, v.ZONE)
    snapshots.write_daily(top.where("rank <= 30"), path, _EARLIER, v.ZONE)
    snapshots.write_daily(top.where("rank <= 10"), path, v.AS_OF, v.ZONE)
    snapshots.write_daily(top, path, v.AS_OF, v.ZONE)
    return read.read_daily(spark, path)


_SQL_DAILY = f"""
{_SQL_TOP}, daily AS (
  SELECT '2024-01-30' AS date, * FROM top WHERE rank <= 30 UNION ALL SELECT '2024-01-31' AS date, * FROM top)"""


@register("snapshot_daily", f"{_SQL_DAILY} SELECT date, rank, url, source FROM daily")
def snapshot_daily(spark, sf):
    return published(spark, sf).select(F.col("date").cast("string").alias("date"), "rank", "url", "source")


@register("latest_view", f"{_SQL_DAILY} SELECT rank, url FROM daily WHERE date = (SELECT max(date) FROM daily)")
def latest_view(spark, sf):
    return read.latest_view(published(spark, sf)).select("rank", "url")


@register("snapshot_latest", f"{_SQL_TOP} SELECT '2024-01-31' AS date, rank, url FROM top")
def snapshot_latest(spark, sf):
    path = scratch_path(spark, "latest")
    top = with_content(chosen(spark, sf))
    snapshots.write_latest(top.where("rank <= 30"), path, _EARLIER, v.ZONE)
    snapshots.write_latest(top, path, v.AS_OF, v.ZONE)
    return read.read_latest(spark, path).select("date", "rank", "url")


def document(spark, sf):
    errors = stats.all_errors(acquire(a.registry(spark, sf), a.landed(spark, sf), v.ZONE).errors)
    return snapshots.envelope(with_content(chosen(spark, sf)), errors, v.AS_OF, v.ZONE)


_SQL_JSON = f"""to_json(CASE WHEN {_SQL_HTML} IS NULL
  THEN json_object('title', title, 'url', url, 'summary', summary, 'published_at', iso, 'source', source)
  ELSE json_object('title', title, 'url', url, 'summary', summary, 'published_at', iso, 'source', source,
                   'content_html', {_SQL_HTML}) END)"""


@register("snapshot_envelope", f"""
{_SQL_TOP}, {a.SQL_ACQUIRED}, listed AS (SELECT *, {v.sql_iso('published_at')} AS iso FROM top)
SELECT '2024-01-31' AS date, '{v.ZONE}' AS timezone, {v.sql_iso(v.SQL_AS_OF)} AS generated_at, count(*) AS count,
       string_agg({_SQL_JSON}, ',' ORDER BY rank) AS items,
       (SELECT count(*) FROM acquired_errors) AS n_errors,
       (SELECT string_agg(j, ',' ORDER BY j) FROM (
          SELECT CAST(json_object('source', source, 'error', error) AS VARCHAR) AS j FROM acquired_errors)) AS errors
FROM listed""")
def snapshot_envelope(spark, sf):
    return document(spark, sf)


@register("snapshot_scan", f"""
{_SQL_TOP}
SELECT '2024-01-31' AS date, title, url, summary, {v.sql_iso('published_at')} AS published_at, source,
       {_SQL_HTML} AS content_html FROM top""")
def snapshot_scan(spark, sf):
    """The document written as JSON and read back as rows."""
    path = scratch_path(spark, "envelope")
    snapshots.write_envelope(document(spark, sf), path)
    return read.snapshot_items(read.read_envelope(spark, path))


_SQL_PUB_DATE = v.sql_rss_date(f"coalesce(published_at, {v.SQL_AS_OF})")
_SQL_XML = f"""'<item>' || chr(10) || '<title>' || {v.sql_escape('title')} || '</title>' || chr(10)
  || '<link>' || {v.sql_escape('url')} || '</link>' || chr(10)
  || '<guid isPermaLink=''false''>' || substr(sha1(url), 1, 16) || '</guid>' || chr(10)
  || '<pubDate>' || {_SQL_PUB_DATE} || '</pubDate>' || chr(10)
  || CASE WHEN summary = '' THEN '' ELSE '<description>' || {v.sql_escape('summary')} || '</description>' || chr(10) END
  || '</item>'"""


@register("rss_items", f"{_SQL_TOP} SELECT rank, {_SQL_XML} AS xml FROM top")
def rss_items(spark, sf):
    return rss.rss_items(chosen(spark, sf), v.AS_OF, v.ZONE)


@register("rss_document", f"""
{_SQL_TOP}
SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0">' || chr(10) || '<channel>' || chr(10)
  || '<title>Daily &amp; more</title>' || chr(10) || '<link>https://news.example.org/</link>' || chr(10)
  || '<description>What the day brought</description>' || chr(10)
  || '<lastBuildDate>' || {v.sql_rss_date(v.SQL_AS_OF)} || '</lastBuildDate>' || chr(10)
  || string_agg({_SQL_XML}, chr(10) ORDER BY rank) || chr(10) || '</channel>' || chr(10) || '</rss>' AS value
FROM top""")
def rss_document(spark, sf):
    return rss.rss_document(chosen(spark, sf), v.AS_OF, _CHANNEL, v.ZONE)


@register("run_stats", f"""
{_SQL_TOP}, {v.SQL_PAGE_ITEMS}, {a.SQL_ACQUIRED}
SELECT (SELECT count(*) FROM top) AS articles_collected,
       (SELECT count(*) + count(*) FILTER (page_id % 2 = 1) FROM page_items) AS cache_entries,
       (SELECT count(*) FROM acquired_errors) AS errors,
       least(100, (SELECT count(*) + count(*) FILTER (page_id % 2 = 1) FROM page_items)) AS cache_entries_kept""")
def run_stats(spark, sf):
    cache = cache_upsert(v.content_cache(spark, sf), caches.new_content(spark, sf))
    errors = acquire(a.registry(spark, sf), a.landed(spark, sf), v.ZONE).errors
    return stats.run_stats(chosen(spark, sf), cache, errors, max_cache=100)


@register("error_sink", f"""
{SQL_FETCH_ERRORS}, {a.SQL_ACQUIRED}
SELECT '2024-01-31' AS date, source, NULL AS url, error FROM acquired_errors
UNION ALL SELECT '2024-01-31', source, url, error FROM failed""")
def error_sink(spark, sf):
    """Errors of both stages in one table beside the snapshot; another run of a day replaces its errors."""
    errors = stats.all_errors(
        acquire(a.registry(spark, sf), a.landed(spark, sf), v.ZONE).errors, merged(spark, sf).errors
    )
    path = scratch_path(spark, "errors")
    earlier, today = (snapshots.day_of(spark, day, v.ZONE) for day in (_EARLIER, v.AS_OF))
    for found, day in ((errors, earlier), (errors.limit(0), earlier), (errors.limit(3), today), (errors, today)):
        stats.write_errors(found, path, day)
    return spark.read.parquet(path).select(F.col("date").cast("string").alias("date"), "source", "url", "error")


_SQL_RUN = f"""
WITH {a.SQL_ACQUIRED},
items AS (SELECT seq, source, title, url, summary, make_timestamp(published_us) AS published_at FROM acquired_items),
{v.SQL_DEDUPED},
policy AS (SELECT DISTINCT 'src-' || k AS source, 168 AS recent_hours, k % 3 AS min_keep FROM numbered),
{v.sql_selected('deduped')}"""


# what a run meets, by the number n of an address /n/n: cached content of some age, rules, and what a fetch brings
_PAGES = f"""SELECT DISTINCT k, event_id % 70 AS n, 'https://s' || k || '.example.org/n/' || event_id % 70 AS url FROM"""
_STORY = "'Story ' || n || repeat(' goes on with enough words', 8)"


def run_cache(spark, sf):
    pages = spark.sql(f"{_PAGES} {{e}}", e=a.numbered(spark, sf)).where("n % 5 = 0")
    return pages.selectExpr(
        "url", "'<p>Kept ' || n || '</p>' AS content_html",
        f"timestamp '{v.AS_OF}Z' - make_dt_interval(cast(n % 20 AS int)) AS fetched_at",
    )


def run_rules(spark, sf):
    """Every third source refuses some of its pages."""
    return a.numbered(spark, sf).where("k % 3 = 0").selectExpr(
        "'s' || k || '.example.org' AS host", "'*' AS agent", "0 AS group_ord", "0 AS rule_ord", "false AS allow",
        "'/n/1' AS path_prefix",
    ).distinct()


def run_fetched(spark, sf):
    """Refused, unreadable and good pages; some were asked for twice."""
    pages = spark.sql(f"{_PAGES} {{e}}", e=a.numbered(spark, sf))
    once = pages.selectExpr(
        "url", "CAST(CASE WHEN n % 4 = 0 THEN 404 ELSE 200 END AS int) AS status",
        f"CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN '{UNREADABLE}' ELSE '<html><body><p>' || {_STORY} || '</p></body></html>' END AS html",
        "CASE WHEN n % 4 = 0 THEN 'HTTPError: 404' END AS error",
    )
    again = pages.where("n % 8 = 2").selectExpr(
        "url", "CAST(NULL AS int) AS status", "CAST(NULL AS string) AS html", "'ReadTimeout' AS error")
    return once.unionByName(again)


_SQL_MET = f"""
{_SQL_RUN}, top AS (SELECT * FROM ranked WHERE rank <= 120),
placed AS (
  SELECT *, TRY_CAST(regexp_extract(url, '/n/([0-9]+)$', 1) AS INT) AS n, CAST(substr(source, 5) AS INT) AS k FROM top),
hits AS (SELECT *, coalesce(n % 5 = 0 AND n % 20 <= 14, false) AS hit FROM placed),
asked AS (
  SELECT * FROM hits WHERE NOT hit AND NOT (k % 3 = 0 AND coalesce(starts_with(n::VARCHAR, '1'), false))
  ORDER BY rank LIMIT 30),
story AS (SELECT seq, '<p>' || {_STORY} || '</p>' AS html FROM asked WHERE n % 4 > 1),
refused AS (
  SELECT source, url, CASE n % 4 WHEN 0 THEN 'HTTPError: 404' ELSE '{UNREADABLE_ERROR.replace("'", "''")}' END AS error
  FROM asked WHERE n % 4 < 2),
items_out AS (
  SELECT rank, h.seq, source, title, url, summary, published_at,
         CASE WHEN hit THEN '<p>Kept ' || n || '</p>' ELSE html END AS content_html
  FROM hits h LEFT JOIN story USING (seq)),
errors_out AS (SELECT source, NULL AS url, error FROM acquired_errors UNION ALL SELECT source, url, error FROM refused)"""


def whole_run(spark, sf):
    return daily_run(
        a.registry(spark, sf), a.landed(spark, sf), run_cache(spark, sf), run_rules(spark, sf), run_fetched(spark, sf),
        v.AS_OF, _CHANNEL, v.ZONE,
    )


@register("daily_run", f"""
{_SQL_MET}
SELECT rank, seq, source, title, url, summary, epoch_us(published_at) AS published_us, content_html FROM items_out""")
def daily(spark, sf):
    """A whole run from landed responses to ranked items with their content."""
    return whole_run(spark, sf).items.select(
        "rank", "seq", "source", "title", "url", "summary", F.unix_micros("published_at").alias("published_us"),
        "content_html",
    )


@register("daily_errors", f"{_SQL_MET} SELECT source, url, error FROM errors_out")
def daily_errors(spark, sf):
    """Errors of all stages of a run."""
    return whole_run(spark, sf).errors


@register("daily_publish", f"""
{_SQL_MET}
SELECT '2024-01-31' AS date, (SELECT count(*) FROM items_out) AS daily,
       (SELECT count(content_html) FROM items_out) AS latest_with_content, (SELECT count(*) FROM errors_out) AS errors,
       (SELECT count(*) FROM items_out) AS listed, (SELECT count(*) FROM items_out) AS rss_items,
       (SELECT count(*) FROM story) AS cache_rows, (SELECT count(*) FROM items_out) AS articles_collected,
       (SELECT count(*) FROM errors_out) AS errors_counted, true AS timed""")
def daily_publish(spark, sf):
    """A run published, and what a reader finds then."""
    to = Published.under(scratch_path(spark, "published"))
    publish(whole_run(spark, sf), to, v.AS_OF, time.time(), v.ZONE)

    def count(df, name, what=F.lit(1)):
        return df.agg(F.count(what).alias(name))

    parts = [
        spark.read.parquet(to.daily).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("daily")),
        count(read.read_latest(spark, to.latest), "latest_with_content", F.col("content_html")),
        count(spark.read.parquet(to.errors), "errors"),
        count(read.snapshot_items(read.read_envelope(spark, to.document)), "listed"),
        count(spark.read.text(to.rss).where("value = '<item>'"), "rss_items"),
        count(read_cache(spark, to.cache), "cache_rows"),
        spark.read.parquet(to.stats).select(
            "articles_collected", F.col("errors").alias("errors_counted"), (F.col("execution_time") >= 0).alias("timed")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


@register("reader_find", f"""
{_SQL_TOP}
SELECT seq, url, source, title,
       CASE WHEN seq % 3 = 1 THEN 'content' WHEN summary <> '' THEN 'summary' ELSE 'none' END AS body_kind
FROM top WHERE source = 'view'""")
def reader_find(spark, sf):
    """Cards of one source that match a query."""
    found = find(with_content(chosen(spark, sf)), "Iten", "view", v.ZONE)
    return found.select("seq", "url", "source", "title", "body_kind")
