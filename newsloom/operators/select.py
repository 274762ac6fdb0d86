"""From all acquired items to the items of a run: dedup, recency, top-up, order, cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import settings
from newsloom.functions.dates import instant
from newsloom.functions.text import strip_ws
from newsloom.operators.skew import fits_broadcast, lookup_join, top_per_group


def arrival_seq(source_ord: Column, strategy_ord: Column, feed_ord: Column, entry_ord: Column) -> Column:
    """Arrival key as one number: 28 bits of source, 2 of strategy, 3 of feed, 30 of entry.

    It depends on the data only, so a different input split gives the same
    order.  A number beyond its bits would change the order silently, so it
    fails the job.
    """
    def field(c, bits, name):
        c = c.cast("bigint")
        fits = c.isNull() | ((c >= 0) & (c < (1 << bits)))
        beyond = F.raise_error(F.concat(F.lit(f"{name} has no room in the arrival key: "), c.cast("string")))
        return F.when(fits, c).otherwise(beyond.cast("bigint"))

    return (
        F.shiftleft(field(source_ord, 28, "source"), 35) + F.shiftleft(field(strategy_ord, 2, "strategy"), 33)
        + F.shiftleft(field(feed_ord, 3, "feed"), 30) + field(entry_ord, 30, "entry")
    )


def required_fields(items: DataFrame) -> DataFrame:
    """Items without url or title are not items."""
    return items.where((F.length("url") > 0) & (F.length("title") > 0))


def deduplicate(items: DataFrame) -> DataFrame:
    """One row per url over all sources: the first to arrive.

    The rank limit is also applied before the shuffle, so a url with very many
    copies leaves each task as one row.
    """
    first = Window.partitionBy("url").orderBy("seq")
    return (
        items.where(F.length("url") > 0)
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") == 1)
        .drop("_rn")
        .withColumn("title", strip_ws(F.col("title")))
        .withColumn("summary", strip_ws(F.col("summary")))
    )


def feed_cap(entries: DataFrame, feed: str, order: str, cap: int = settings.MAX_FEED_ENTRIES) -> DataFrame:
    """First entries of each feed by position."""
    w = Window.partitionBy(feed).orderBy(order)
    return entries.withColumn("entry_ord", F.row_number().over(w)).where(F.col("entry_ord") <= cap)


def with_policy(items: DataFrame, policy: DataFrame, fits: bool | None = None) -> DataFrame:
    """Attach recent_hours and min_keep of the item's source, or the defaults."""
    rules = policy.select("source", "recent_hours", "min_keep")
    joined = lookup_join(items, rules, "source", spread="seq", fits=fits)
    return joined.withColumn(
        "recent_hours", F.coalesce("recent_hours", F.lit(settings.DEFAULT_RECENT_HOURS)).cast("int")
    ).withColumn("min_keep", F.coalesce("min_keep", F.lit(settings.DEFAULT_MIN_KEEP)).cast("int"))


def is_recent(as_of, undated: str = "keep") -> Column:
    """Inside the source's window (bound included).  Undated items pass unless dropped."""
    cutoff = instant(as_of) - F.make_dt_interval(F.lit(0), F.col("recent_hours"))
    dated = F.coalesce(F.col("published_at") >= cutoff, F.lit(False))
    return dated | F.col("published_at").isNull() if undated == "keep" else dated


def recent_items(items: DataFrame, policy: DataFrame, as_of, undated: str = "keep") -> DataFrame:
    return with_policy(items, policy).where(is_recent(as_of, undated))


def sort_ts() -> Column:
    """Date used for ordering: an undated item counts as the epoch."""
    return F.coalesce(F.col("published_at"), F.timestamp_seconds(F.lit(0)))


def kept_per_source(items: DataFrame, policy: DataFrame, as_of) -> DataFrame:
    """Kept and total count per source, pre-aggregated before the shuffle."""
    return (
        with_policy(items, policy)
        .groupBy("source")
        .agg(F.count_if(is_recent(as_of)).alias("kept"), F.count("*").alias("total"))
    )


def recent_or_topped_up(items: DataFrame, policy: DataFrame, as_of, undated: str = "keep") -> DataFrame:
    """Recent items, plus the newest others of each source that is short of min_keep.

    `items` is read three times; hand over a stored table when it is costly.
    Adds `topup` (1 for added rows) and `src_first_seq` (arrival of the source,
    0 for recent rows), which the final order needs.
    """
    rules = policy.select("source", "recent_hours", "min_keep")
    fits = fits_broadcast(rules)
    marked = with_policy(items, rules, fits).withColumn("_recent", is_recent(as_of, undated))
    recent = marked.where("_recent").withColumn("topup", F.lit(0)).withColumn(
        "src_first_seq", F.lit(0).cast("bigint")
    )
    wants_more = marked.where(F.col("min_keep") > 0)
    short = (
        wants_more.groupBy("source")
        .agg(
            (F.max("min_keep") - F.count_if("_recent")).alias("_need"),
            F.min("seq").alias("src_first_seq"),
        )
        .where(F.col("_need") > 0)
    )
    # the policy is configuration: its largest min_keep is one bounded number
    most = policy.agg(F.max("min_keep").alias("m")).first()["m"] or 0
    # at most one short row per policy row, and no wider: it fits where the policy does
    spare = lookup_join(
        wants_more.where(~F.col("_recent")), short, "source", spread="seq", how="inner", fits=fits
    ).withColumn("_ts", sort_ts())
    added = top_per_group(
        spare, "source", [F.col("_ts").desc(), F.col("seq")], need="_need", at_most=max(most, 0), spread="seq"
    ).withColumn("topup", F.lit(1)).drop("_ts", "_need")
    return recent.unionByName(added).drop("_recent")


def newest_first_order() -> list[Column]:
    """Newest first; ties keep arrival order, topped-up rows after the others."""
    return [F.col("sort_ts").desc(), F.col("topup"), F.col("src_first_seq"), F.col("seq")]


def newest_first(items: DataFrame) -> DataFrame:
    return items.withColumn("sort_ts", sort_ts()).orderBy(*newest_first_order())


def cap_items(items: DataFrame, limit: int = settings.MAX_ITEMS) -> DataFrame:
    """First `limit` items in final order, with their rank.

    The limit is a top-k, so the rank runs over `limit` rows only.
    """
    top = newest_first(items).limit(limit)
    whole = Window.orderBy(*newest_first_order())
    return top.withColumn("rank", F.row_number().over(whole).cast("bigint"))


def select_items(items: DataFrame, policy: DataFrame, as_of, limit: int = settings.MAX_ITEMS) -> DataFrame:
    """Acquired items to the items of a run."""
    return cap_items(recent_or_topped_up(deduplicate(items), policy, as_of), limit)
