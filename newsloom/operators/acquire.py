"""From landed responses to items: which strategy counts for which source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from newsloom import settings
from newsloom.functions.text import summary_backfill
from newsloom.operators.content import main_content
from newsloom.operators.links import discovered_feeds, page_links, selector_supported
from newsloom.operators.select import arrival_seq
from newsloom.session import dealt, stored
from newsloom.sources.feeds import read_entries, usable

FEED, DISCOVERED, LINKS = 0, 1, 2  # order of the strategies
BAD_ADDRESS = "invalid address in feed"
BAD_SELECTOR = "selector not understood: "
ITEM_COLUMNS = ("seq", "source", "title", "url", "summary", "published_at")


@dataclass(frozen=True)
class Acquired:
    items: DataFrame
    errors: DataFrame


def union_sources(*frames: DataFrame) -> DataFrame:
    """Items of all strategies: one scan per strategy, not one per source."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def routes(registry: DataFrame, landed: DataFrame) -> DataFrame:
    """Per source the route taken (feed, fallback, homepage) or its error.

    Reads only statuses, never bodies.
    """
    def of(strategy, column):
        return F.max(F.when(F.col("strategy") == strategy, F.col(column)))

    seen = landed.where(F.col("strategy") != "discovered").groupBy("source").agg(
        of("feed", "status").alias("feed_status"), of("feed", "error").alias("feed_error"),
        of("homepage", "status").alias("home_status"), of("homepage", "error").alias("home_error"),
    )
    known = registry.join(seen, registry["name"] == seen["source"], "left").drop("source")
    feed_ok = F.coalesce(F.col("feed_status") == 200, F.lit(False))
    home_ok = F.coalesce(F.col("home_status") == 200, F.lit(False))
    may_fall_back = F.coalesce(F.array_contains("fallback_statuses", F.col("feed_status")), F.lit(False))
    has_feed, has_home = F.col("feed").isNotNull(), F.col("homepage").isNotNull()
    route = (
        F.when(has_feed & feed_ok, F.lit("feed"))
        .when(has_feed & may_fall_back & home_ok, F.lit("fallback"))
        .when(~has_feed & has_home & home_ok, F.lit("homepage"))
    )
    no_answer = F.lit("no response")
    failed_fallback = F.concat(
        F.lit("Feed "), F.col("feed_status").cast("string"), F.lit(settings.FALLBACK_FAILED),
        F.coalesce("home_error", no_answer),
    )
    error = (
        F.when(route.isNotNull(), F.lit(None).cast("string"))
        .when(has_feed & may_fall_back, failed_fallback)
        .when(has_feed, F.coalesce("feed_error", no_answer))
        .when(~has_home, F.lit(settings.NO_ADDRESS))
        .otherwise(F.coalesce("home_error", no_answer))
    )
    return known.select(
        "source_ord", F.col("name").alias("source"), "homepage", "selector",
        route.alias("route"), error.alias("error"),
    )


def acquire(registry: DataFrame, landed: DataFrame, zone: str = settings.DEFAULT_TIMEZONE) -> Acquired:
    """Items and errors of all sources.

    An explicit feed is final even when it is empty; a homepage gives its
    discovered feeds if they have any item, else its links.  Every feed
    document is parsed once: its entries, readable or not, are written, and
    items and errors are both read from there.  Stored bodies are few bytes but
    much work, and the files of one strategy lie together, so documents and
    pages are dealt over tasks by their text before they are read.
    """
    chosen = stored(routes(registry, landed), "routes")
    sizes = landed.where(F.col("status") == 200).groupBy((F.col("strategy") == "homepage").alias("home")).agg(
        F.sum(F.octet_length("body")).alias("n"))
    size = {r["home"]: r["n"] or 0 for r in sizes.collect()}  # two rows: of pages, of feeds
    bodies = landed.where((F.col("status") == 200) & (F.col("strategy") != "discovered")).select(
        "source", "strategy", "body"
    )
    fed = chosen.where(F.col("route") == "feed").select("source_ord", "source")
    feeds = bodies.where(F.col("strategy") == "feed").join(fed, "source").select(
        "source_ord", "source", F.lit(FEED).alias("strategy_ord"), F.lit(0).cast("bigint").alias("feed_ord"), "body"
    )

    homed = chosen.where(F.col("route").isin("fallback", "homepage")).drop("error")
    homes = (
        bodies.where(F.col("strategy") == "homepage").drop("strategy").withColumnRenamed("body", "html")
        .join(homed, "source")
    )
    open_homes = homes.where(F.col("route") == "homepage").select("source_ord", "source", "homepage", "html")
    announced = discovered_feeds(dealt(open_homes, size.get(True, 0), "source_ord", "html"), base="homepage").select("source_ord", "source", "feed_ord", "feed_url")
    answers = landed.where((F.col("status") == 200) & (F.col("strategy") == "discovered")).select(
        "source", F.col("url").alias("feed_url"), "body"
    )
    discovered = announced.join(answers, ["source", "feed_url"]).select(
        "source_ord", "source", F.lit(DISCOVERED).alias("strategy_ord"), "feed_ord", "body"
    )
    documents = dealt(feeds.unionByName(discovered), size.get(False, 0), "source_ord", "body")
    entries = stored(read_entries(documents, zone=zone), "entries")
    # one unusable address fails a whole explicit feed
    broken = entries.where(
        (F.col("strategy_ord") == FEED) & ~F.col("corrupt") & F.col("bad_url") & (F.length("url") > 0)
    ).select("source").distinct()
    from_feeds = entries.where(usable()).join(broken, "source", "left_anti").drop("corrupt", "repaired", "bad_url")
    found = entries.where(usable() & (F.col("strategy_ord") == DISCOVERED)).select("source").distinct()
    linkless = homes.join(found, "source", "left_anti")
    linked = linkless.where(selector_supported(F.col("selector")))
    links = page_links(dealt(linked, size.get(True, 0), "source_ord", "html"), base="homepage", selector=F.col("selector")).select(
        "source_ord", "source", "entry_ord", "title", F.col("url_out").alias("url"),
        F.lit("").alias("summary"), F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(LINKS).alias("strategy_ord"), F.lit(0).cast("bigint").alias("feed_ord"),
    )
    tagged = union_sources(from_feeds, links)
    items = tagged.withColumn(
        "seq", arrival_seq(*(F.col(c) for c in ("source_ord", "strategy_ord", "feed_ord", "entry_ord")))
    ).select(*ITEM_COLUMNS)
    errors = chosen.where(F.col("error").isNotNull()).select("source", "error").unionByName(
        broken.withColumn("error", F.lit(BAD_ADDRESS))
    ).unionByName(
        linkless.where(~selector_supported(F.col("selector"))).select(
            "source", F.concat(F.lit(BAD_SELECTOR), F.col("selector")).alias("error"))
    )
    return Acquired(items, errors)


def fetch_merge(items: DataFrame, fetched: DataFrame) -> Acquired:
    """Page responses back to the items that were fetched, by url.

    `fetched` has url, status, html, error.  Failures become errors, and so
    does a page that cannot be read; a page without content leaves its item
    unchanged.  Of several responses for a url one counts: a good one before
    others, then the first by its text.
    """
    good = F.col("error").isNull() & F.coalesce(F.col("status") == 200, F.lit(False))
    best = Window.partitionBy("url").orderBy(good.desc(), F.xxhash64("html"), "html", "status", "error")
    # a fetched page costs tokenising, so only pages of these items are read; several steps read them
    wanted = stored(fetched.join(items.select("url"), "url", "left_semi").withColumn(
        "_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn"), "wanted")
    pages = wanted.where(good).select("url", "html").withColumn("base", F.col("url"))
    read = stored(main_content(pages, key="url", url="base"), "content")
    content = read.where(F.col("content_html") != "").select("url", "content_html")
    merged = (
        items.drop("content_html").join(content, "url", "left")
        .withColumn("summary", summary_backfill(F.col("summary"), F.col("content_html")))
    )
    reason = F.coalesce("error", F.concat(F.lit("HTTPError: "), F.col("status").cast("string")), F.lit("no response"))
    failures = wanted.where(~good).select("url", reason.alias("error")).unionByName(
        read.where(F.col("error").isNotNull()).select("url", "error"))
    errors = failures.join(items.select("url", "source"), "url").select("source", "url", "error")
    return Acquired(merged, errors)
