"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import views as v
from newsloom.catalog.registered import register
from newsloom.functions import cards, dates, text, urls

_SPACED = "concat(chr(9), ' ', replace(text, ' de ', concat(' de', '\u0085')), '​  ')"


@register("strip_ws", f"""
SELECT doc_id, {v.sql_strip(_SPACED)} AS text, {v.sql_strip('CAST(NULL AS VARCHAR)')} AS blank FROM documents""")
def strip_ws(spark, sf):
    d = v.documents(spark, sf)
    return d.select(
        "doc_id", text.strip_ws(F.expr(_SPACED)).alias("text"),
        text.strip_ws(F.lit(None).cast("string")).alias("blank"),
    )


@register("make_id", "SELECT page_id, substr(sha1(url), 1, 16) AS id, substr(sha1(''), 1, 16) AS none FROM pages")
def make_id(spark, sf):
    return v.pages(spark, sf).select(
        "page_id", text.make_id(F.col("url")).alias("id"), text.make_id(F.lit(None).cast("string")).alias("none")
    )


_ODD_URL = """CASE page_id % 5 WHEN 1 THEN replace(url, 'http', 'HTTP') WHEN 2 THEN '  ' || url
  WHEN 3 THEN replace(url, '.example', chr(9) || '.example') WHEN 4 THEN replace(url, '?', ';p=1?') ELSE url END"""


@register("clean_url", f"""
SELECT page_id, regexp_replace(replace(trim(replace(u, chr(9), '')), 'HTTP', 'http'), '[?#].*$', '') AS url, bad
FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN replace(url, '://', '://[') ELSE {_ODD_URL} END AS u,
             page_id % 7 = 0 AS bad FROM pages)""")
def clean_url(spark, sf):
    odd = v.pages(spark, sf).select(
        "page_id", F.expr(f"CASE WHEN page_id % 7 = 0 THEN replace(url, '://', '://[') ELSE {_ODD_URL} END").alias("u")
    )
    return odd.select("page_id", urls.clean_url(F.col("u")).alias("url"), urls.is_bad_url(F.col("u")).alias("bad"))


_FORMS = 22


def date_texts(spark, sf):
    """Dates of events in many written forms, some unreadable."""
    def shown(fmt, shift=0):
        return f"date_format(ts + make_dt_interval(0, {shift}), '{fmt}')"

    forms = [
        f"concat({shown('EEE, dd MMM yyyy HH:mm:ss', 10)}, ' +1000')",
        f"concat({shown('dd MMM yyyy HH:mm:ss')}, ' GMT')",
        f"concat({shown('yyyy-MM-dd', 10)}, 'T', {shown('HH:mm:ss.SSSSSS', 10)}, '+10:00')",
        f"concat({shown('yyyy-MM-dd')}, 'T', {shown('HH:mm:ss')}, 'Z')",
        shown("yyyy-MM-dd"), shown("dd MMM yyyy"), shown("dd MMMM yyyy"), shown("MM/dd/yyyy"),
        "'next week'", "''", "NULL",
        f"concat({shown('EEEE, dd MMMM yyyy hh:mm', 10)}, {shown(' a', 10)})",
        f"concat({shown('dd MMM yy HH:mm:ss')}, ' GMT')",
        f"concat({shown('yyyy-MM-dd', 10)}, 'T', {shown('HH:mm:ss', 10)}, '+10')",
        f"concat({shown('yyyyMMdd')}, 'T', {shown('HHmmss')}, 'Z')",
        shown("EEE MMM d HH:mm:ss yyyy", 10), shown("dd MMM yyyy h a", 10), shown("MM.dd.yyyy"),
        f"concat({shown('EEEE MMMM d')}, 'th, ', {shown('yyyy')})", shown("M/d/yy"), shown("yyyy-MM"),
        f"concat({shown('yyyy-MM-dd')}, 'T24:00:00')",
    ]
    branches = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    iso = f"concat({shown('yyyy-MM-dd')}, ' ', {shown('HH:mm:ss')}, '+00:00')"
    return v.table(spark, sf, "events").selectExpr(
        "event_id", f"CASE event_id % {_FORMS} {branches} END AS published",
        f"CASE event_id % {_FORMS} WHEN 8 THEN {iso} END AS updated",
        f"CASE event_id % {_FORMS} WHEN 8 THEN '1999-01-01' WHEN 9 THEN {iso} END AS created",
    )


@register("parse_date", f"""
SELECT event_id, epoch_us(CASE
    WHEN event_id % {_FORMS} = 2 THEN ts
    WHEN event_id % {_FORMS} IN (0, 1, 3, 8, 9, 12, 13, 14, 15) THEN date_trunc('second', ts)
    WHEN event_id % {_FORMS} = 16 THEN date_trunc('hour', ts)
    WHEN event_id % {_FORMS} IN (4, 5, 6, 7, 17, 18, 19) THEN date_trunc('day', ts) - INTERVAL 10 HOUR
    WHEN event_id % {_FORMS} = 20 THEN date_trunc('month', ts) - INTERVAL 10 HOUR
    WHEN event_id % {_FORMS} = 21 THEN date_trunc('day', ts) + INTERVAL 14 HOUR
    WHEN event_id % {_FORMS} = 11 THEN date_trunc('minute', ts) END) AS at_us
FROM events""")
def parse_date(spark, sf):
    d = date_texts(spark, sf)
    at = dates.parse_date(F.col("published"), F.col("updated"), F.col("created"), v.ZONE)
    return d.select("event_id", F.unix_micros(at).alias("at_us"))


_HALF_WHOLE = "CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END"


@register("to_iso", f"""
SELECT event_id, {v.sql_iso('t')} AS local, {v.sql_iso('t', 0, '+00:00')} AS utc
FROM (SELECT event_id, {_HALF_WHOLE} AS t FROM events)""")
def to_iso(spark, sf):
    e = v.events(spark, sf).withColumn("t", F.expr(_HALF_WHOLE.replace("ts", "at")))
    return e.select(
        "event_id", dates.to_iso(F.col("t"), v.ZONE).alias("local"), dates.to_iso(F.col("t"), "UTC").alias("utc")
    )


@register("rss_date", f"""
WITH {v.SQL_ITEMS}
SELECT seq, {v.sql_rss_date(f'coalesce(published_at, {v.SQL_AS_OF})')} AS pub_date FROM items""")
def rss_date(spark, sf):
    return v.items(spark, sf).select("seq", dates.rss_date(F.col("published_at"), v.AS_OF, v.ZONE).alias("pub_date"))


@register("display_time", f"""
WITH {v.SQL_ITEMS}
SELECT seq, coalesce(strftime(published_at + INTERVAL 10 HOUR, '%-d %b, %I:%M ')
  || lower(strftime(published_at + INTERVAL 10 HOUR, '%p')), '') AS shown FROM items""")
def display_time(spark, sf):
    return v.items(spark, sf).select("seq", dates.display_time(F.col("published_at"), v.ZONE).alias("shown"))


@register("html_text", f"SELECT page_id, {v.sql_joined_text('html')} AS text FROM pages")
def html_text(spark, sf):
    return v.pages(spark, sf).select("page_id", text.html_text(F.col("html")).alias("text"))


@register("summary_backfill", f"""
WITH {v.SQL_PAGE_ITEMS}
SELECT page_id, CASE WHEN summary = '' THEN substr({v.sql_joined_text('html')}, 1, 280) ELSE summary END AS summary
FROM page_items""")
def summary_backfill(spark, sf):
    p = v.page_items(spark, sf)
    return p.select("page_id", text.summary_backfill(F.col("summary"), F.col("html")).alias("summary"))


@register("truncate_html", """
SELECT page_id, CASE WHEN length(html) > 8000 THEN substr(html, 1, 8000) || '…' ELSE html END AS html FROM pages""")
def truncate_html(spark, sf):
    return v.pages(spark, sf).select("page_id", text.truncate_html(F.col("html")).alias("html"))


@register("xml_escape", f"SELECT page_id, {v.sql_escape('html')} AS html FROM pages")
def xml_escape(spark, sf):
    return v.pages(spark, sf).select("page_id", text.xml_escape(F.col("html")).alias("html"))


@register("rss_guid", f"""
SELECT page_id, substr(sha1(CASE WHEN page_id % 4 = 0 THEN {v.sql_escape("'A & B ' || page_id")} || 'Mon' ELSE url END),
                       1, 16) AS guid
FROM pages""")
def rss_guid(spark, sf):
    url = F.expr("CASE WHEN page_id % 4 <> 0 THEN url END")
    return v.pages(spark, sf).select(
        "page_id", text.rss_guid(url, F.expr("'A & B ' || page_id"), F.lit("Mon")).alias("guid")
    )


# one base per page, every written form of a link to its own id
_HREFS = {
    "'/n/' || page_id || '?q=1'": "origin || '/n/' || page_id || '?q=1'",
    "'n/' || page_id": "origin || folder || 'n/' || page_id",
    "'../n/./' || page_id": "origin || parent || 'n/' || page_id",
    "'../../../n//' || page_id || '/..'": "origin || '/n/'",
    "'//cdn.example.org/' || page_id": "scheme || '//cdn.example.org/' || page_id",
    "'?k=' || page_id": "origin || path || '?k=' || page_id",
    "'mailto:u' || page_id || '@example.org'": "'mailto:u' || page_id || '@example.org'",
    # only a link of the base's own scheme is rewritten
    "'HTTPS://o.example.org/' || page_id || '#z'":
        "CASE scheme WHEN 'https:' THEN scheme ELSE 'HTTPS:' END || '//o.example.org/' || page_id || '#z'",
    "'#s' || page_id": "origin || path || query || '#s' || page_id",
}


@register("resolve_url", f"""
WITH based AS (
  SELECT *, regexp_replace(path, '[^/]*$', '') AS folder,
         regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') AS parent FROM (
    SELECT page_id, {v.SQL_ORIGIN} AS origin, {v.SQL_PATH} AS path,
           regexp_extract(url, '^[a-z]+:') AS scheme, regexp_extract(url, '[?][^#]*') AS query FROM pages))
{" UNION ALL ".join(f"SELECT page_id, {i} AS form, {sql} AS url FROM based" for i, sql in enumerate(_HREFS.values()))}
""")
def resolve_url(spark, sf):
    hrefs = F.array(*(F.expr(h) for h in _HREFS))
    p = v.pages(spark, sf).select("page_id", "url", F.posexplode(hrefs).alias("form", "href"))
    return p.select("page_id", "form", urls.resolve_url(F.col("url"), F.col("href")).alias("url"))


@register("search_text", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS content_text FROM pages")
def search_text(spark, sf):
    return v.pages(spark, sf).select("page_id", text.search_text(F.col("html")).alias("content_text"))


_CARD = """page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS title,
  CASE WHEN page_id % 3 <> 0 THEN html END AS content_html,
  CASE WHEN page_id % 2 = 0 THEN '' ELSE 'S' || page_id END AS summary"""


@register("display_card", f"""
SELECT page_id, CASE WHEN title = '' THEN '(untitled)' ELSE title END AS title,
       CASE WHEN content_html IS NOT NULL THEN 'content' WHEN summary <> '' THEN 'summary' ELSE 'none' END AS body_kind,
       coalesce(content_html, summary) AS body
FROM (SELECT {_CARD} FROM pages)""")
def display_card(spark, sf):
    c = v.pages(spark, sf).select(*(F.expr(e) for e in (
        "page_id", "CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS title",
        "CASE WHEN page_id % 3 <> 0 THEN html END AS content_html",
        "CASE WHEN page_id % 2 = 0 THEN '' ELSE 'S' || page_id END AS summary")))
    return c.select(
        "page_id", cards.card_title(F.col("title")).alias("title"),
        cards.card_body_kind(F.col("content_html"), F.col("summary")).alias("body_kind"),
        cards.card_body(F.col("content_html"), F.col("summary")).alias("body"),
    )


@register("tz_label", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '''' || source || '''' END AS label FROM documents""")
def tz_label(spark, sf):
    name = F.expr("CASE WHEN doc_id % 2 = 0 THEN source ELSE concat('tzfile(', chr(39), source, chr(39), ')') END")
    return v.documents(spark, sf).select("doc_id", text.tz_label(name).alias("label"))
