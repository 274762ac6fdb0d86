"""Inputs of the registered queries, derived from the given tables by Spark, and
the same derivations as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions.dates import from_utc_wall
from newsloom.functions.urls import clean_url
from newsloom.session import spread
from newsloom.sources.pages import read_pages

AS_OF = "2024-01-31 00:00:00"  # UTC
ZONE = "Australia/Brisbane"    # +10:00, no daylight saving

# ---------------------------------------------------------------- SQL helpers
SQL_AS_OF = f"TIMESTAMP '{AS_OF}'"
_SQL_BLANKS = (
    r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def sql_strip(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SQL_BLANKS}', ' ', 'g'))"


def sql_clean_url(x: str) -> str:
    return f"regexp_replace({x}, '[?#].*$', '')"


def sql_decode(x: str) -> str:
    """The references that occur in the pages; the ampersand last, so nothing is decoded twice."""
    out = x
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return out


def sql_escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def sql_without(x: str, *tags: str) -> str:
    out = x
    for t in tags:
        out = f"regexp_replace({out}, '(?s)<{t}[ >].*?</{t}>', '', 'g')"
    return out


def sql_spaced_text(x: str) -> str:
    """Text nodes joined by spaces."""
    return sql_strip(sql_decode(f"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"))


def sql_joined_text(x: str) -> str:
    """Text nodes joined by nothing, scripts and styles left out."""
    bare = sql_without(x, "script", "style")
    return sql_strip(sql_decode(f"regexp_replace({bare}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"))


def sql_iso(ts: str, hours: int = 10, offset: str = "+10:00") -> str:
    local = f"({ts} + INTERVAL {hours} HOUR)"
    return (
        f"strftime({local}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' ELSE strftime({local}, '.%f') END || '{offset}'"
    )


def sql_rss_date(ts: str) -> str:
    return f"strftime({ts} + INTERVAL 10 HOUR, '%a, %d %b %Y %H:%M:%S +1000')"


def sql_rows(rows) -> str:
    """Configuration rows as SQL values."""
    def value(x):
        return f"'{x}'" if isinstance(x, str) else str(x).lower()

    return ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)


# -------------------------------------------------------------------- tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, spread over the cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with ts as an instant; the stored clock time is UTC."""
    return table(spark, sf_dir, "events").withColumn("at", from_utc_wall(F.col("ts")))


# --------------------------------------------------------------------- items
def items_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per event; a tenth undated, a third without summary, urls repeat
    within and across sources."""
    return events(spark, sf_dir).selectExpr(
        "event_id AS seq", "event_type AS source", "'Item  ' || event_id AS title",
        """CASE WHEN event_id % 2 = 0 THEN 'https://news.example.org/n/' || (event_id % 8000)
                ELSE 'https://' || event_type || '.example.org/n/' || (event_id % 6000) END
           || '?e=' || event_id || '#x' AS raw_url""",
        "CASE WHEN event_id % 10 = 0 THEN NULL ELSE at END AS published_at",
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Item  ' || event_id END AS summary",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_raw(spark, sf_dir).withColumn("url", clean_url(F.col("raw_url"))).drop("raw_url")


SQL_ITEMS = f"""
items AS (
  SELECT *, {sql_clean_url('raw_url')} AS url FROM (
    SELECT event_id AS seq, event_type AS source, 'Item  ' || event_id AS title,
           CASE WHEN event_id % 2 = 0 THEN 'https://news.example.org/n/' || (event_id % 8000)
                ELSE 'https://' || event_type || '.example.org/n/' || (event_id % 6000) END
             || '?e=' || event_id || '#x' AS raw_url,
           CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS published_at,
           CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Item  ' || event_id END AS summary
    FROM events))"""

SQL_DEDUPED = f"""
deduped AS (
  SELECT seq, source, {sql_strip('title')} AS title, url, {sql_strip('summary')} AS summary, published_at
  FROM items QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)"""

_POLICY_ROWS = [("click", 24, 0), ("view", 1, 400), ("purchase", 168, 3), ("signup", 1, 10)]


def policy(spark: SparkSession) -> DataFrame:
    """Per-source rules: configuration, not data; one source has none."""
    return spark.sql(f"SELECT * FROM VALUES {sql_rows(_POLICY_ROWS)} AS t(source, recent_hours, min_keep)")


SQL_POLICY = (
    f"policy(source, recent_hours, min_keep) AS (VALUES {sql_rows(_POLICY_ROWS)})"
)


def sql_selected(items_cte: str, policy_cte: str = "policy") -> str:
    """CTEs marked, kept, ranked over a table of deduplicated items."""
    return f"""
marked AS (
  SELECT d.*, coalesce(p.recent_hours, 168) AS recent_hours, coalesce(p.min_keep, 0) AS min_keep,
         (published_at IS NULL OR published_at >= {SQL_AS_OF} - to_hours(coalesce(p.recent_hours, 168))) AS recent
  FROM {items_cte} d LEFT JOIN {policy_cte} p USING (source)),
counted AS (
  SELECT *, count(*) FILTER (recent) OVER (PARTITION BY source) AS kept_n,
         min(seq) OVER (PARTITION BY source) AS first_seq,
         row_number() OVER (PARTITION BY source, recent
           ORDER BY coalesce(published_at, TIMESTAMP '1970-01-01') DESC, seq) AS rn
  FROM marked),
kept AS (
  SELECT seq, source, title, url, summary, published_at,
         CASE WHEN recent THEN 0 ELSE 1 END AS topup, CASE WHEN recent THEN 0 ELSE first_seq END AS src_first_seq
  FROM counted WHERE recent OR (min_keep > 0 AND rn <= min_keep - kept_n)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY coalesce(published_at, TIMESTAMP '1970-01-01') DESC,
                               topup, src_first_seq, seq) AS rank
  FROM kept)"""


SQL_SELECTION = f"WITH {SQL_ITEMS}, {SQL_DEDUPED}, {SQL_POLICY}, {sql_selected('deduped')}"

# --------------------------------------------------------------------- pages
SQL_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
SQL_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per page; the address gets the page id, which makes it unique."""
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("seq"), F.regexp_extract("url", "://([^./]+)", 1).alias("source"),
        F.expr("'Page ' || page_id").alias("title"),
        F.concat(clean_url(F.col("url")), F.lit("/p"), F.col("page_id").cast("string")).alias("url"),
        F.expr("CASE WHEN page_id % 3 = 0 THEN '' ELSE 'About ' || page_id END").alias("summary"),
        "html", "page_id",
    )


SQL_PAGE_ITEMS = f"""
page_items AS (
  SELECT page_id AS seq, regexp_extract(url, '://([^./]+)', 1) AS source, 'Page ' || page_id AS title,
         {sql_clean_url('url')} || '/p' || page_id AS url,
         CASE WHEN page_id % 3 = 0 THEN '' ELSE 'About ' || page_id END AS summary, html, page_id
  FROM pages)"""


def content_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache row per page: some empty, some without time, ages 0 to 29 days."""
    return page_items(spark, sf_dir).select(
        "url",
        F.expr("CASE WHEN page_id % 11 = 0 THEN '' ELSE html END").alias("content_html"),
        F.expr(
            f"CASE WHEN page_id % 13 <> 0 THEN timestamp '{AS_OF}Z' - make_dt_interval(cast(page_id % 30 AS int)) END"
        ).alias("fetched_at"),
    )


SQL_CACHE = f"""
cache AS (
  SELECT url, CASE WHEN page_id % 11 = 0 THEN '' ELSE html END AS content_html,
         CASE WHEN page_id % 13 <> 0 THEN {SQL_AS_OF} - to_days((page_id % 30)::INT) END AS fetched_at
  FROM page_items)"""


def cache_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that look for their content: every page's url, and one url each that is not cached."""
    own = page_items(spark, sf_dir).drop("html", "page_id")
    other = own.withColumn("url", F.concat("url", F.lit("/new"))).withColumn("seq", F.col("seq") + 1_000_000_000)
    return own.unionByName(other).withColumn("content_html", F.lit(None).cast("string"))


SQL_READERS = """
readers AS (
  SELECT seq, source, title, url, summary FROM page_items
  UNION ALL SELECT seq + 1000000000, source, title, url || '/new', summary FROM page_items)"""

SQL_PAGE_CACHE = f"WITH {SQL_PAGE_ITEMS}, {SQL_CACHE}, {SQL_READERS}"
