"""What a reader does with a snapshot: search, filter, show."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom import settings
from newsloom.functions.cards import card_body, card_body_kind, card_title
from newsloom.functions.dates import display_time
from newsloom.operators.search import search, search_docs


def cards(items: DataFrame, zone: str = settings.DEFAULT_TIMEZONE) -> DataFrame:
    """Items as they are shown."""
    return items.select(
        "seq", "url", "source",
        card_title(F.col("title")).alias("title"),
        display_time(F.col("published_at"), zone).alias("shown_time"),
        card_body_kind(F.col("content_html"), F.col("summary")).alias("body_kind"),
        card_body(F.col("content_html"), F.col("summary")).alias("body"),
    )


def find(items: DataFrame, query: str = "", source: str = "", zone: str = settings.DEFAULT_TIMEZONE) -> DataFrame:
    """Cards of the items that match a query within a source, best first."""
    return cards(search(search_docs(items), query, source), zone)
