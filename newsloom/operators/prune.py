"""Boilerplate removal as table work over page nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import settings
from newsloom.functions.text import strip_ws, xml_escape
from newsloom.functions.urls import resolve_url
from newsloom.operators.nodes import drop_subtrees, is_element


def blocked_tag() -> Column:
    return F.col("tag").isin(*settings.REMOVED_TAGS)


def blocked_role() -> Column:
    return F.coalesce(F.lower("role").isin(*settings.REMOVED_ROLES), F.lit(False))


def blocked_class() -> Column:
    """Any of the words anywhere in the class list ('nav' also hits 'navy')."""
    words = "|".join(settings.REMOVED_CLASS_WORDS)
    return F.coalesce(F.col("class").rlike(f"(?i)(?:{words})"), F.lit(False))


def own_page_anchor() -> Column:
    return (F.col("tag") == "a") & F.coalesce(F.startswith("href", F.lit("#")), F.lit(False))


def image() -> Column:
    return F.col("tag") == "img"


def drop_linky(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove lists and divs that are mostly links.

    Running counts of links and text are read at the two ends of each element;
    their difference is what the element holds.  Judging all elements at once
    is the same as judging them outside in: removing an inner one comes after
    the verdict on the outer one.
    """
    so_far = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = Window.partitionBy(*keys, "elem")
    size = F.length(strip_ws(F.col("text")))
    # each text piece and one space after it
    chars = F.when((F.col("kind") == "text") & (size > 0), size + 1)
    if "pieces" in nodes.columns:  # packed nodes
        chars = F.when(F.col("kind").isin("run", "leaves"), F.col("chars") + F.col("pieces")).otherwise(chars)
    counted = nodes.withColumn(
        "_links", F.count_if((F.col("kind") == "open") & (F.col("tag") == "a")).over(so_far)
    ).withColumn(
        "_chars", F.coalesce(F.sum(chars).over(so_far), F.lit(0))
    )
    held = counted.withColumn("_links", F.max("_links").over(ends) - F.min("_links").over(ends)).withColumn(
        "_chars", F.max("_chars").over(ends) - F.min("_chars").over(ends) - 1
    )
    many = F.col("_links") >= settings.LINKY_MIN_LINKS
    few = (F.col("_links") >= settings.LINKY_FEW_LINKS) & (F.col("_chars") < settings.LINKY_SHORT_TEXT)
    linky = F.col("tag").isin(*settings.LINKY_TAGS) & (many | few)
    return drop_subtrees(held, keys, linky).drop("_links", "_chars")


def absolute_links(nodes: DataFrame, base: str = "url") -> DataFrame:
    """Links of anchors relative to the page become absolute."""
    link = is_element() & (F.col("tag") == "a") & F.col("href").isNotNull()
    return nodes.withColumn(
        "href", F.when(link, resolve_url(F.col(base), F.col("href"))).otherwise(F.col("href"))
    )


def absolutize(nodes: DataFrame, keys: Sequence[str], base: str = "url") -> DataFrame:
    """Anchors within the page go, with their text; other links become absolute."""
    return absolute_links(drop_subtrees(nodes, keys, own_page_anchor()), base)


def prune_nodes(nodes: DataFrame, keys: Sequence[str], base: str = "url", also: Column | None = None) -> DataFrame:
    """All removals in order: tags, roles and classes; link blocks; own anchors and images.

    Removals that do not depend on each other share one pass.
    """
    blocked = blocked_tag() | blocked_role() | blocked_class()
    body = drop_subtrees(nodes, keys, blocked if also is None else blocked | also)
    prose = drop_linky(body, keys)
    return absolute_links(drop_subtrees(prose, keys, own_page_anchor() | image()), base)


def node_markup() -> Column:
    """Serialised form of one node."""
    attr = F.replace(xml_escape(F.col("href")), F.lit('"'), F.lit("&quot;"))
    tag = F.concat(F.col("before"), F.when(F.col("href").isNull(), F.lit("")).otherwise(attr), F.col("after"))
    return (
        F.when(F.col("kind") == "text", xml_escape(F.col("text")))
        .when(F.col("kind") == "raw", F.col("text"))
        .otherwise(tag)
    )


def in_order(value: Column, sep: str) -> Column:
    """Aggregate: values of one page joined in page order.  Bounded by the page."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col("ord"), value.alias("v"))))
    return F.array_join(F.transform(pieces, lambda p: p["v"]), sep)


def rebuild(nodes: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Nodes back to one row per page: markup, and text joined by spaces."""
    return nodes.groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in carry),
        in_order(node_markup(), "").alias("html"),
        strip_ws(in_order(F.when(F.col("kind").isin("text", "leaves"), F.col("text")), " ")).alias("text"),
    )


def min_text_gate(pruned: DataFrame, min_chars: int = settings.MIN_CONTENT_CHARS) -> DataFrame:
    """Pages with too little text get empty content."""
    return pruned.withColumn("html", F.when(F.length("text") < min_chars, F.lit("")).otherwise(F.col("html")))
