"""Links, feed addresses and crawl rules of landed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import views as v
from newsloom.catalog.registered import register
from newsloom.catalog.selection import chosen
from newsloom.operators import acquire, counts, links, robots
from newsloom.sources.pages import read_pages


@register("page_scan", "SELECT page_id, url, html FROM pages")
def page_scan(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet")


_SQL_LINKS = f"""
WITH tags AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a,
         generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS entry_ord FROM pages),
links AS (
  SELECT page_id, url AS base, entry_ord, {v.SQL_ORIGIN} AS origin,
         {v.sql_decode("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href,
         {v.sql_strip(v.sql_decode("regexp_extract(a, '>([^<]*)<', 1)"))} AS title FROM tags)"""


@register("page_links", f"""
{_SQL_LINKS}
SELECT page_id, entry_ord, title, {v.sql_clean_url('origin || href')} AS url FROM links
WHERE href <> '' AND title <> ''""")
def page_links(spark, sf):
    return links.page_links(v.pages(spark, sf)).select("page_id", "entry_ord", "title", F.col("url_out").alias("url"))


# forms that are understood, none, one that is not, and a class that no link has
_SELECTOR = """CASE page_id % 6 WHEN 0 THEN "a[href^='/th'], a[href*='er']" WHEN 1 THEN "a[href*='en']"
  WHEN 3 THEN "[href$=n], a[href='/the']" WHEN 4 THEN "h3 a" WHEN 5 THEN "a.lead, .x[href^=/]" END"""


@register("link_selector", f"""
{_SQL_LINKS}
SELECT page_id, entry_ord, href FROM links WHERE href <> '' AND title <> '' AND CASE page_id % 6
  WHEN 0 THEN starts_with(href, '/th') OR contains(href, 'er') WHEN 1 THEN contains(href, 'en') WHEN 2 THEN true
  WHEN 3 THEN ends_with(href, 'n') OR href = '/the' ELSE false END""")
def link_selector(spark, sf):
    return links.page_links(v.pages(spark, sf), selector=F.expr(_SELECTOR)).select("page_id", "entry_ord", "href")


# what a page with feeds has in its head and body
_HEAD = (
    '<link rel="alternate" type="application/rss+xml" href="/all.rss?a=1&amp;b=2">'
    "<link href='/main' rel='Alternate nofollow' type='application/Atom+XML'/>"
    '<link rel="stylesheet" type="text/xml" href="/style"><!-- <a href="/feed/hidden">no</a> -->'
)
_BODY = '<a class="x" href="/Feed/news">News</a><a href=/all.rss?a=1&amp;b=2>Again</a><a href="/sitemap.XML">Map</a>'
_WITH_FEEDS = f"""replace(replace(html, '</head>', '{_HEAD.replace("'", "''")}</head>'), '<body>', '<body>{_BODY}')"""
_SQL_FEEDS = f"""
WITH found AS (
  SELECT page_id, list_distinct_in_order AS urls FROM (
    SELECT page_id, list_concat(
      [{v.SQL_ORIGIN} || '/all.rss?a=1&b=2', {v.SQL_ORIGIN} || '/main', {v.SQL_ORIGIN} || '/Feed/news',
       {v.SQL_ORIGIN} || '/sitemap.XML'],
      list_transform(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1),
        lambda h: regexp_matches(lower(h), '/feed|rss|atom|[.]xml')), lambda h: {v.SQL_ORIGIN} || h)
    ) AS list_distinct_in_order FROM pages)),
numbered AS (
  SELECT page_id, unnest(urls) AS feed_url, generate_subscripts(urls, 1) AS pos FROM found),
feeds AS (
  SELECT page_id, feed_url, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS feed_ord
  FROM numbered GROUP BY page_id, feed_url)"""


def pages_with_feeds(spark, sf):
    spark_sql = _WITH_FEEDS.replace("''", "\\'")
    return v.pages(spark, sf).withColumn("html", F.expr(spark_sql))


@register("feed_discovery", f"{_SQL_FEEDS} SELECT page_id, feed_ord, feed_url FROM feeds")
def feed_discovery(spark, sf):
    return links.feed_discovery(pages_with_feeds(spark, sf)).select("page_id", "feed_ord", "feed_url")


@register("discovered_feed_cap", f"{_SQL_FEEDS} SELECT page_id, feed_ord, feed_url FROM feeds WHERE feed_ord < 2")
def discovered_feed_cap(spark, sf):
    return links.discovered_feeds(pages_with_feeds(spark, sf)).select("page_id", "feed_ord", "feed_url")


# crawl rules by the first label of the host: configuration, not data
_RULES = [
    ("blog", "*", 0, 0, False, "/en/2"), ("blog", "*", 0, 1, True, "/en"), ("blog", "*", 0, 2, False, "/"),
    ("m", "news", 0, 0, False, "/de"), ("m", "newsbot", 1, 0, True, "/"), ("m", "*", 2, 0, False, "/"),
    ("www", "other", 0, 0, False, "/"), ("www", "*", 1, 0, True, "/fr"), ("www", "*", 1, 1, False, "/"),
    ("news", "*", 0, 0, False, ""), ("news", "*", 0, 1, False, "/"),  # a line without a path allows everything
]
_AGENT = "NewsBot/1.0 news-of-the-world"
_RULE_COLUMNS = "(host, agent, group_ord, rule_ord, allow, path_prefix)"
_HOSTS = "SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://([^./]+)', 1) AS label FROM"
_SQL_RULES = f"""labels{_RULE_COLUMNS} AS (VALUES {v.sql_rows(_RULES)}),
rules AS (SELECT h.host, agent, group_ord, rule_ord, allow, path_prefix FROM ({_HOSTS} pages) h JOIN labels ON label = labels.host)"""
_SQL_ROBOTS = f"""
WITH {v.SQL_PAGE_ITEMS}, {_SQL_RULES},
named AS (
  SELECT * FROM rules WHERE agent IN ('*', 'news', 'newsbot')
  QUALIFY (agent <> '*') = max(agent <> '*') OVER (PARTITION BY host)),
mine AS (SELECT * FROM named QUALIFY group_ord = min(group_ord) OVER (PARTITION BY host)),
decided AS (
  SELECT seq, coalesce(arg_min(allow OR path_prefix = '', rule_ord), true) AS allowed
  FROM (SELECT seq, regexp_extract(url, '://([^/?#]+)', 1) AS asked, {v.SQL_PATH} AS path FROM page_items) i
  LEFT JOIN mine ON host = asked AND starts_with(path, path_prefix) GROUP BY seq)"""


def rules(spark, rows=_RULES):
    return spark.sql(f"SELECT * FROM VALUES {v.sql_rows(rows)} AS t{_RULE_COLUMNS}")


def host_rules(spark, sf):
    """The rules of every host of the pages."""
    hosts = spark.sql(f"{_HOSTS} {{p}}", p=v.pages(spark, sf))
    return hosts.join(rules(spark).withColumnRenamed("host", "label"), "label").drop("label")


@register("robots_join", f"{_SQL_ROBOTS} SELECT seq, allowed FROM decided")
def robots_join(spark, sf):
    items = v.page_items(spark, sf).drop("html")
    return robots.robots_join(items, host_rules(spark, sf), _AGENT).select("seq", "allowed")


@register("robots_gate", f"{_SQL_ROBOTS} SELECT seq FROM decided WHERE allowed")
def robots_gate(spark, sf):
    items = v.page_items(spark, sf).drop("html")
    return robots.robots_gate(items, host_rules(spark, sf), _AGENT).select("seq")


@register("fetch_budget", f"""
{v.SQL_SELECTION}
SELECT seq, url FROM ranked WHERE rank <= 120 AND url NOT LIKE 'https://news.example.org/n/1%' ORDER BY rank LIMIT 30""")
def fetch_budget(spark, sf):
    no_ones = rules(spark, [("news.example.org", "*", 0, 0, False, "/n/1")])
    return robots.fetch_budget(robots.robots_gate(chosen(spark, sf), no_ones)).select("seq", "url")


# a response per page: some lost, some refused, some that no reader takes
UNREADABLE = "<p>before<![foo[bar]]>"
UNREADABLE_ERROR = "AssertionError: unknown status keyword 'foo' in marked section"
_RESPONSE = {
    "html": f"CASE WHEN page_id % 14 = 2 THEN '{UNREADABLE}' ELSE html END",
    "status": "CAST(CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN 404 ELSE 200 END AS int)",
    "error": "CASE WHEN page_id % 7 = 0 THEN 'ReadTimeout' WHEN page_id % 7 = 1 THEN 'HTTPError: 404' END",
}


def fetched(spark, sf):
    """Every third good page was asked for twice, and refused once."""
    p = v.page_items(spark, sf)
    again = p.where("page_id % 7 > 1 AND page_id % 3 = 0").select(
        "url", "html", F.lit(503).alias("status"), F.lit("HTTPError: 503").alias("error"))
    return p.select("url", *(F.expr(e).alias(n) for n, e in _RESPONSE.items())).unionByName(again)


def merged(spark, sf):
    items = v.page_items(spark, sf).drop("html", "page_id").withColumn("content_html", F.lit(None).cast("string"))
    return acquire.fetch_merge(items, fetched(spark, sf))


# the extracted content as SQL: pieces of text after each block tag of the given pages
SQL_CONTENT = f"""
bodies AS (
  SELECT page_id, {v.sql_without("regexp_replace(regexp_replace(html, '(?s)^.*?</head>', ''), '(?s)<!--.*?-->', '', 'g')", 'nav', 'footer')} AS b
  FROM pages),
pieces AS (
  SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (
    SELECT page_id, regexp_extract_all(b, '</?(?:div|article|h1|p)[^>]*>(?:[^<]|</?(?:b|br)>)*') AS p FROM bodies)),
blocks AS (
  SELECT page_id, pos, CASE WHEN piece LIKE '<h1%' THEN 'h1' ELSE 'p' END AS tag,
         {v.sql_strip(v.sql_decode("regexp_replace(piece, '<[^>]*>', '', 'g')"))} AS t FROM pieces),
good AS (SELECT * FROM blocks WHERE length(t) > 0 AND (tag = 'h1' OR length(t) >= 25)),
whole AS (
  SELECT page_id, string_agg('<' || tag || '>' || {v.sql_escape('t')} || '</' || tag || '>', '' ORDER BY pos) AS html
  FROM good GROUP BY page_id HAVING length(string_agg(t, ' ' ORDER BY pos)) >= 120),
content AS (
  SELECT page_id, CASE WHEN length(w.html) > 8000 THEN substr(w.html, 1, 8000) || '…'
                       ELSE coalesce(w.html, '') END AS content_html,
         CASE WHEN w.html IS NOT NULL THEN 'blocks' END AS method
  FROM pages LEFT JOIN whole w USING (page_id))"""


@register("fetch_merge", f"""
WITH {v.SQL_PAGE_ITEMS}, {SQL_CONTENT}, found AS (
  SELECT seq, url, summary,
         CASE WHEN page_id % 7 > 1 AND page_id % 14 <> 2 AND content_html <> '' THEN content_html END AS content_html
  FROM page_items JOIN content USING (page_id))
SELECT seq, url, content_html,
       CASE WHEN summary = '' AND content_html IS NOT NULL
            THEN substr({v.sql_strip("replace(replace(replace(regexp_replace(content_html, '</?(?:p|h1)>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")}, 1, 280)
            ELSE summary END AS summary
FROM found""")
def fetch_merge(spark, sf):
    return merged(spark, sf).items.select("seq", "url", "content_html", "summary")


SQL_FETCH_ERRORS = f"""
WITH {v.SQL_PAGE_ITEMS}, failed AS (
  SELECT source, url, CASE WHEN page_id % 7 = 0 THEN 'ReadTimeout' WHEN page_id % 7 = 1 THEN 'HTTPError: 404'
    ELSE '{UNREADABLE_ERROR.replace("'", "''")}' END AS error
  FROM page_items WHERE page_id % 7 < 2 OR page_id % 14 = 2)"""


@register("fetch_errors", f"{SQL_FETCH_ERRORS} SELECT source, url, error FROM failed")
def fetch_errors(spark, sf):
    return merged(spark, sf).errors


@register("error_counts", f"{SQL_FETCH_ERRORS} SELECT source, count(*) AS n FROM failed GROUP BY 1")
def error_counts(spark, sf):
    return counts.error_counts(merged(spark, sf).errors)
