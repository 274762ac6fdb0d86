"""Dedup, recency, top-up, order, caps and counts over the derived items."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import views as v
from newsloom.catalog.registered import register
from newsloom.functions.dates import instant, to_iso
from newsloom.operators import acquire, counts, search, select, skew
from newsloom.plans.daily import choose_items
from newsloom.session import stored
from newsloom.sinks.rss import rss_items
from newsloom.sources.registry import policies, timezone_or_default, with_defaults


def _us(c="published_at"):
    return F.unix_micros(F.col(c)).alias("published_us")


def kept(spark, sf):
    """Recent and topped-up items, before order and cap."""
    deduped = stored(select.deduplicate(v.items(spark, sf)), "deduped")
    return select.recent_or_topped_up(deduped, v.policy(spark), v.AS_OF)


def chosen(spark, sf, limit=120):
    return choose_items(v.items(spark, sf), v.policy(spark), v.AS_OF, limit)


@register("select_items", f"""
{v.SQL_SELECTION}
SELECT rank, seq, source, title, url, summary, epoch_us(published_at) AS published_us, topup FROM ranked
WHERE rank <= 120""")
def select_items(spark, sf):
    return chosen(spark, sf).select("rank", "seq", "source", "title", "url", "summary", _us(), "topup")


@register("required_fields", f"""
WITH {v.SQL_ITEMS}
SELECT seq, url FROM items WHERE seq % 7 <> 0 AND seq % 5 <> 0""")
def required_fields(spark, sf):
    holes = v.items(spark, sf).withColumn("url", F.expr("CASE WHEN seq % 7 = 0 THEN '' ELSE url END"))
    holes = holes.withColumn("title", F.expr("CASE WHEN seq % 5 = 0 THEN NULL ELSE title END"))
    return select.required_fields(holes).select("seq", "url")


@register("dedup_first", f"""
WITH {v.SQL_ITEMS}, {v.SQL_DEDUPED}
SELECT seq, source, title, url, summary, epoch_us(published_at) AS published_us FROM deduped""")
def dedup_first(spark, sf):
    return select.deduplicate(v.items(spark, sf)).select("seq", "source", "title", "url", "summary", _us())


@register("policy_join", f"""
WITH {v.SQL_ITEMS}, {v.SQL_POLICY}
SELECT seq, coalesce(recent_hours, 168) AS recent_hours, coalesce(min_keep, 0) AS min_keep
FROM items LEFT JOIN policy USING (source)""")
def policy_join(spark, sf):
    return select.with_policy(v.items(spark, sf), v.policy(spark)).select("seq", "recent_hours", "min_keep")


@register("recent_items", f"""
{v.SQL_SELECTION}
SELECT seq, source, epoch_us(published_at) AS published_us FROM marked WHERE recent""")
def recent_items(spark, sf):
    deduped = select.deduplicate(v.items(spark, sf))
    return select.recent_items(deduped, v.policy(spark), v.AS_OF).select("seq", "source", _us())


@register("min_keep_topup", f"""
{v.SQL_SELECTION}
SELECT seq, source, url, topup, src_first_seq FROM kept""")
def min_keep_topup(spark, sf):
    return kept(spark, sf).select("seq", "source", "url", "topup", "src_first_seq")


@register("min_keep_topup_many", f"""
WITH many AS (SELECT event_id AS seq, 'u' || user_id AS source, 't' AS title, 'u' || event_id AS url, '' AS summary,
                     ts AS published_at FROM events),
policy AS (SELECT DISTINCT 'u' || user_id AS source, 1 AS recent_hours, 5 AS min_keep FROM events),
{v.sql_selected('many')}
SELECT seq, source, topup FROM kept""")
def min_keep_topup_many(spark, sf):
    e = v.events(spark, sf)
    many = e.selectExpr(
        "event_id AS seq", "'u' || user_id AS source", "'t' AS title", "'u' || event_id AS url", "'' AS summary",
        "at AS published_at",
    )
    policy = e.selectExpr("'u' || user_id AS source", "1 AS recent_hours", "5 AS min_keep").distinct()
    return select.recent_or_topped_up(many, policy, v.AS_OF).select("seq", "source", "topup")


@register("newest_first", f"{v.SQL_SELECTION} SELECT rank, seq, url FROM ranked")
def newest_first(spark, sf):
    """The order of all kept items, as a rank that no single task computes."""
    ordered = kept(spark, sf).withColumn("sort_ts", select.sort_ts())
    return skew.distributed_rank(ordered, select.newest_first_order()).select("rank", "seq", "url")


@register("cap_120", f"{v.SQL_SELECTION} SELECT rank, seq, source, url FROM ranked WHERE rank <= 120")
def cap_120(spark, sf):
    return select.cap_items(kept(spark, sf)).select("rank", "seq", "source", "url")


@register("rss_cap", f"{v.SQL_SELECTION} SELECT rank FROM ranked WHERE rank <= 200")
def rss_cap(spark, sf):
    return rss_items(select.cap_items(kept(spark, sf), limit=500), v.AS_OF, v.ZONE).select("rank")


@register("arrival_order", """
SELECT event_id, (event_id // 100) * 34359738368 + (event_id % 3) * 8589934592
                 + (event_id % 2) * 1073741824 + event_id % 100 AS seq FROM events""")
def arrival_order(spark, sf):
    parts = [F.expr(e) for e in ("event_id div 100", "event_id % 3", "event_id % 2", "event_id % 100")]
    return v.events(spark, sf).select("event_id", select.arrival_seq(*parts).alias("seq"))


@register("feed_cap", """
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS entry_ord FROM events
QUALIFY entry_ord <= 80""")
def feed_cap(spark, sf):
    e = v.table(spark, sf, "events").select("event_type", "event_id")
    return select.feed_cap(e, "event_type", "event_id").withColumn("entry_ord", F.col("entry_ord").cast("bigint"))


@register("source_filter", f"WITH {v.SQL_ITEMS} SELECT seq, source, url FROM items WHERE source = 'view'")
def source_filter(spark, sf):
    return search.source_filter(v.items(spark, sf), "view").select("seq", "source", "url")


@register("union_sources", f"WITH {v.SQL_ITEMS} SELECT seq, source, seq % 3 AS strategy_ord FROM items")
def union_sources(spark, sf):
    """One frame per strategy, united."""
    own = v.items(spark, sf).select("seq", "source", (F.col("seq") % 3).alias("strategy_ord"))
    return acquire.union_sources(*(own.where(F.col("strategy_ord") == s) for s in range(3)))


@register("per_source_counts", f"{v.SQL_SELECTION} SELECT source, count(*) AS n FROM ranked WHERE rank <= 120 GROUP BY 1")
def per_source_counts(spark, sf):
    return counts.per_source_counts(chosen(spark, sf))


@register("kept_per_source", f"""
{v.SQL_SELECTION}
SELECT source, count(*) FILTER (recent) AS kept, count(*) AS total FROM marked GROUP BY 1""")
def kept_per_source(spark, sf):
    return select.kept_per_source(select.deduplicate(v.items(spark, sf)), v.policy(spark), v.AS_OF)


@register("distinct_sources", f"WITH {v.SQL_ITEMS} SELECT DISTINCT source FROM items")
def distinct_sources(spark, sf):
    return counts.distinct_sources(v.items(spark, sf))


@register("headline", f"""
{v.SQL_SELECTION}
SELECT count(*) AS n, {v.sql_iso(v.SQL_AS_OF)} AS generated_at FROM ranked WHERE rank <= 120""")
def headline(spark, sf):
    return counts.headline(chosen(spark, sf), to_iso(instant(v.AS_OF), v.ZONE))


@register("items_by_source_list", f"""
WITH {v.SQL_ITEMS}, {v.SQL_DEDUPED}
SELECT source, row_number() OVER (PARTITION BY source ORDER BY seq) AS pos, seq FROM deduped""")
def items_by_source_list(spark, sf):
    return counts.items_by_source(select.deduplicate(v.items(spark, sf))).select("source", "pos", "seq")



@register("source_registry", f"""
WITH raw AS (
  SELECT k AS source_ord, CASE WHEN k % 31 <> 7 THEN 'src-' || (k % 90) END AS name,
         CASE WHEN k % 4 = 0 THEN 45 END AS timeout, CASE WHEN k % 8 = 0 THEN 60 END AS feed_timeout,
         CAST(CASE WHEN k % 3 <> 0 THEN 24 + k % 50 END AS INTEGER) AS recent_hours,
         CAST(CASE WHEN k % 5 = 0 THEN k % 7 END AS INTEGER) AS min_keep
  FROM (SELECT DISTINCT event_id // 100 AS k FROM events)),
filled AS (
  SELECT source_ord, coalesce(name, 'Unknown Source') AS name, coalesce(timeout, 20) AS timeout,
         coalesce(feed_timeout, timeout, 20) AS feed_timeout, coalesce(recent_hours, 168) AS recent_hours,
         coalesce(min_keep, 0) AS min_keep FROM raw)
SELECT source_ord, name, timeout, feed_timeout, p.recent_hours, p.min_keep, '{v.ZONE}' AS timezone
FROM filled f JOIN (
  SELECT name AS pname, recent_hours, min_keep FROM filled
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY source_ord DESC) = 1) p ON f.name = p.pname""")
def source_registry(spark, sf):
    raw = (
        v.table(spark, sf, "events").selectExpr("event_id div 100 AS k").distinct()
        .selectExpr(
            "k AS source_ord", "CASE WHEN k % 31 <> 7 THEN 'src-' || (k % 90) END AS name",
            "CAST(CASE WHEN k % 4 = 0 THEN 45 END AS int) AS timeout",
            "CAST(CASE WHEN k % 8 = 0 THEN 60 END AS int) AS feed_timeout",
            "CAST(CASE WHEN k % 3 <> 0 THEN 24 + k % 50 END AS int) AS recent_hours",
            "CAST(CASE WHEN k % 5 = 0 THEN k % 7 END AS string) AS min_keep",  # numbers may be written as text
            "CAST(NULL AS map<string,string>) AS headers", "CAST(NULL AS array<int>) AS fallback_statuses",
        )
    )
    rules = policies(raw).withColumnRenamed("source", "name")
    return (
        with_defaults(raw).select("source_ord", "name", "timeout", "feed_timeout").join(rules, "name")
        .withColumn("timezone", F.lit(timezone_or_default("Mars/Olympus")))
    )
