"""The RSS document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import settings
from newsloom.functions.dates import instant, rss_date
from newsloom.functions.text import rss_guid, xml_escape


@dataclass(frozen=True)
class Channel:
    """What a reader of the feed is shown about it."""

    title: str
    link: str
    description: str


def _element(tag: str, value: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{attrs}>"), value, F.lit(f"</{tag}>"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)  # NULL parts leave no line


def rss_items(items: DataFrame, as_of, zone: str = settings.DEFAULT_TIMEZONE,
              limit: int = settings.MAX_RSS_ITEMS) -> DataFrame:
    """(rank, xml) of the first ranked items; an empty summary has no line."""
    date = rss_date(F.col("published_at"), as_of, zone)
    summary = F.coalesce("summary", F.lit(""))
    xml = _lines(
        F.lit("<item>"),
        _element("title", xml_escape(F.col("title"))),
        _element("link", xml_escape(F.col("url"))),
        _element("guid", rss_guid(F.col("url"), F.col("title"), date), " isPermaLink='false'"),
        _element("pubDate", date),
        F.when(summary != "", _element("description", xml_escape(summary))),
        F.lit("</item>"),
    )
    return items.where(F.col("rank") <= limit).select("rank", xml.alias("xml"))


def rss_document(items: DataFrame, as_of, channel: Channel, zone: str = settings.DEFAULT_TIMEZONE) -> DataFrame:
    """The whole document as one text; bounded by the item limit."""
    parts = rss_items(items, as_of, zone).agg(F.array_sort(F.collect_list(F.struct("rank", "xml"))).alias("_items"))
    head = _lines(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit('<rss version="2.0">'), F.lit("<channel>"),
        _element("title", xml_escape(F.lit(channel.title))),
        _element("link", xml_escape(F.lit(channel.link))),
        _element("description", xml_escape(F.lit(channel.description))),
        _element("lastBuildDate", rss_date(instant(as_of), as_of, zone)),
    )
    body = F.array_join(F.transform("_items", lambda i: i["xml"]), "\n")
    return parts.select(
        _lines(head, F.when(body != "", body), F.lit("</channel>"), F.lit("</rss>")).alias("value")
    )


def write_rss(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)
