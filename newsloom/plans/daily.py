"""One whole run: landed responses in, published snapshot out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from newsloom import settings
from newsloom.functions.dates import instant
from newsloom.operators.acquire import acquire, fetch_merge
from newsloom.operators.cache import cache_hits, cache_misses, cache_upsert, fresh_cache
from newsloom.operators.robots import fetch_budget, robots_gate
from newsloom.operators.select import cap_items, deduplicate, recent_or_topped_up
from newsloom.session import clear_scratch, materialise, scratch_paths, stored
from newsloom.sinks.cache import write_cache
from newsloom.sinks.rss import Channel, rss_document, write_rss
from newsloom.sinks.snapshots import day_of, envelope, write_daily, write_envelope, write_latest
from newsloom.sinks.stats import all_errors, run_stats, timed, write_errors, write_stats
from newsloom.sources.cache import sound_cache
from newsloom.sources.registry import policies


_BROADCAST_ROWS = 100_000  # urls


@dataclass(frozen=True)
class Run:
    items: DataFrame     # ranked, with content where there is any
    errors: DataFrame
    new_cache: DataFrame  # content extracted in this run
    envelope: DataFrame
    rss: DataFrame
    stats: DataFrame
    scratch: tuple[str, ...] = ()  # intermediate tables


@dataclass(frozen=True)
class Published:
    """Where a run is published."""

    daily: str
    latest: str
    document: str
    rss: str
    cache: str
    stats: str
    errors: str

    @classmethod
    def under(cls, folder: str) -> Published:
        return cls(*(f"{folder}/{name}" for name in cls.__dataclass_fields__))


def publish(run: Run, to: Published, as_of, started: float, zone: str = settings.DEFAULT_TIMEZONE,
            max_cache: int | None = settings.CACHE_MAX_ENTRIES) -> None:
    """Write everything of a run; intermediate tables go when it is done.

    `started` is the time.time() at which the run began.  A run of the same
    day replaces what is there; the cache gets a version.  A cache that cannot
    be read starts empty, and the errors of the run say so.
    """
    spark = run.items.sparkSession
    day = day_of(spark, as_of, zone)
    write_daily(run.items, to.daily, as_of, zone)
    write_latest(run.items, to.latest, as_of, zone)
    write_envelope(run.envelope, to.document)
    write_rss(run.rss, to.rss)
    base, damage = sound_cache(spark, to.cache)
    write_cache(spark, to.cache, run.new_cache, max_cache, base=base)
    write_errors(run.errors.unionByName(damage), to.errors, day)
    write_stats(timed(run.stats, time.time() - started), to.stats, day)
    clear_scratch(spark, run.scratch)


def choose_items(items: DataFrame, policy: DataFrame, as_of, limit: int = settings.MAX_ITEMS) -> DataFrame:
    """Dedup, recency and top-up, order and cap.

    The deduplicated table is written once, since three steps read it.
    """
    return cap_items(recent_or_topped_up(stored(deduplicate(items), "deduped"), policy, as_of), limit)


def daily_run(registry: DataFrame, landed: DataFrame, cache: DataFrame, rules: DataFrame, fetched: DataFrame,
              as_of, channel: Channel, zone: str = settings.DEFAULT_TIMEZONE, agent: str = "*",
              limit: int = settings.MAX_ITEMS, budget: int = settings.MAX_NEW_FETCHES) -> Run:
    """Everything one run publishes.

    After the cap at most `limit` rows are left: they are materialised, and the
    large tables are first reduced to their urls, by a broadcast where the
    limit keeps it small.
    """
    small = (lambda df: F.broadcast(df)) if max(limit, budget) <= _BROADCAST_ROWS else (lambda df: df)
    before = set(scratch_paths())
    acquired = acquire(registry, landed, zone)
    kept = materialise(choose_items(acquired.items, policies(registry), as_of, limit)).drop("sort_ts")

    urls = small(kept.select("url"))
    near_cache = materialise(fresh_cache(cache, as_of).join(urls, "url", "left_semi"))
    with_hits = cache_hits(kept, near_cache, as_of)
    candidates = robots_gate(cache_misses(kept, near_cache, as_of), rules, agent)
    to_fetch = materialise(fetch_budget(candidates, budget))

    near_pages = fetched.join(small(to_fetch.select("url")), "url", "left_semi")
    merged = fetch_merge(to_fetch, near_pages)
    new = materialise(merged.items.where(F.col("content_html").isNotNull()).select("url", "content_html", "summary"))
    extra = new.select("url", F.col("content_html").alias("_html"), F.col("summary").alias("_summary"))
    items = with_hits.join(extra, "url", "left").withColumns({
        "content_html": F.coalesce("content_html", "_html"),
        "summary": F.coalesce("_summary", "summary"),
    }).drop("_html", "_summary")

    items = materialise(items)
    errors = stored(all_errors(acquired.errors, merged.errors), "errors")
    new_cache = new.select("url", "content_html", instant(as_of).alias("fetched_at"))
    return Run(
        items=items.orderBy("rank"),
        errors=errors,
        new_cache=new_cache,
        envelope=envelope(items, errors, as_of, zone),
        rss=rss_document(items, as_of, channel, zone),
        stats=run_stats(items, cache_upsert(cache, new_cache), errors),
        scratch=tuple(p for p in scratch_paths() if p not in before),
    )
