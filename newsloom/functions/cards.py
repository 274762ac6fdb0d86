"""What a reader sees of one item."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def card_title(title: Column) -> Column:
    return F.when(_filled(title), title).otherwise(F.lit("(untitled)"))


def card_body_kind(content_html: Column, summary: Column) -> Column:
    """Full content is preferred, then the summary, then nothing."""
    return (
        F.when(_filled(content_html), F.lit("content"))
        .when(_filled(summary), F.lit("summary"))
        .otherwise(F.lit("none"))
    )


def card_body(content_html: Column, summary: Column) -> Column:
    return (
        F.when(_filled(content_html), content_html)
        .when(_filled(summary), summary)
        .otherwise(F.lit(""))
    )
