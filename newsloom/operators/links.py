"""Links and feed addresses of landed pages, by Catalyst pattern matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import settings
from newsloom.functions.bind import computed
from newsloom.functions.text import decode_entities, decode_entities_each, html_text
from newsloom.functions.urls import clean_url, resolve_url

# what the page shows is not in comments, scripts or styles
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_ATTRS = r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+"
_ANCHOR = rf"(?is)<a(?=[\s>/]){_ATTRS}>.*?(?=</a\s*>|<a[\s>]|\z)"
_A_TAG = rf"(?is)<a(?=[\s>/]){_ATTRS}>"
_LINK_TAG = rf"(?is)<link(?=[\s>/]){_ATTRS}>"
_INNER = rf"(?is)^<a(?=[\s>/]){_ATTRS}>(.*)$"


def _attribute(tag: Column, name: str) -> Column:
    """Raw value of an attribute, '' where it is absent."""
    other = rf"[\s/]+(?!{name}\s*=)[^\s=>/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']*))?"
    value = F.regexp_extract(
        tag, rf"(?is)^<\w+(?:{other})*+[\s/]+{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1
    )
    return F.regexp_replace(value, r"^[\"']|[\"']$", "")


def _visible(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")


# one way to name links: a, classes, conditions on the address
_CONDITION = r"\[\s*href\s*([\^*$]?)=\s*(\"[^\"]*\"|'[^']*'|[^\]\"'\s]+)\s*\]"
_ALTERNATIVE = rf"^(?:a|(?=[.\[]))((?:\.[\w-]+)*)((?:{_CONDITION})*)$"


def _alternatives(selector: Column) -> Column:
    """The parts between commas that are not inside brackets."""
    parts = F.split(F.coalesce(selector, F.lit("")), r",(?![^\[]*\])")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def selector_supported(selector: Column) -> Column:
    """Whether every part of a selector is understood: a, a.class, .class, a[href=..], ^=, *=, $=, and their lists."""
    return F.forall(_alternatives(selector), lambda p: p.rlike(_ALTERNATIVE))


def selector_rules(selector: Column) -> Column:
    """Alternatives of a selector: the classes and the address conditions that each demands.

    A selector that is not supported has one alternative that nothing fits.
    """
    def rule(part):
        ops, needles = (F.regexp_extract_all(part, F.lit(_CONDITION), F.lit(i)) for i in (1, 2))
        classes = F.filter(F.split(F.regexp_extract(part, _ALTERNATIVE, 1), r"\."), lambda c: c != "")
        conditions = F.zip_with(ops, needles, lambda op, needle: F.named_struct(
            F.lit("op"), op, F.lit("needle"), F.regexp_replace(needle, r"^[\"']|[\"']$", "")))
        return F.named_struct(
            F.lit("classes"), classes, F.lit("conditions"), conditions, F.lit("known"), part.rlike(_ALTERNATIVE))

    return F.transform(_alternatives(selector), rule)


def link_selected(href: Column, classes: Column, rules: Column) -> Column:
    """True when any alternative fits, or the selector is empty; never under a selector that is not understood."""
    own = F.split(F.coalesce(classes, F.lit("")), r"\s+")

    def holds(c):
        return (
            F.when(c["op"] == "^", F.startswith(href, c["needle"])).when(c["op"] == "*", F.contains(href, c["needle"]))
            .when(c["op"] == "$", F.endswith(href, c["needle"])).otherwise(href == c["needle"])
        )

    fits = F.exists(rules, lambda r: F.forall(r["conditions"], holds) & (F.size(F.array_except(r["classes"], own)) == 0))
    return (F.size(rules) == 0) | (F.forall(rules, lambda r: r["known"]) & fits)


def page_links(pages: DataFrame, base: str = "url", html: str = "html", selector: Column | None = None) -> DataFrame:
    """Items from the links of a page: title, clean absolute url, no summary, no date."""
    rest = [c for c in pages.columns if c != html]
    rules = selector_rules(F.lit(None).cast("string") if selector is None else selector)
    anchors = pages.select(
        *rest, rules.alias("_rules"),
        F.posexplode(F.regexp_extract_all(_visible(F.col(html)), F.lit(_ANCHOR), F.lit(0))).alias("entry_ord", "_a"),
    )
    read = computed(anchors, [*rest, "_rules"], {
        "entry_ord": F.col("entry_ord").cast("bigint"),
        "href": decode_entities(_attribute(F.col("_a"), "href")),
        "_class": _attribute(F.col("_a"), "class"),
        "title": html_text(F.regexp_extract("_a", _INNER, 1)),
    })
    return (
        read.where((F.col("href") != "") & (F.col("title") != "") & link_selected(F.col("href"), F.col("_class"), F.col("_rules")))
        .drop("_rules", "_class")
        .withColumn("url_out", clean_url(resolve_url(F.col(base), F.col("href"))))
    )


def feed_discovery(pages: DataFrame, base: str = "url", html: str = "html",
                   cap: int | None = None) -> DataFrame:
    """Feed addresses a page announces (link tags first), then those its links suggest.

    Everything happens in the page's own row, so there is no shuffle;
    array_distinct keeps the first of equal addresses.
    """
    rest = [c for c in pages.columns if c != html]
    shown = _visible(F.col(html))

    def tags(pattern):
        return F.regexp_extract_all(shown, F.lit(pattern), F.lit(0))

    def announces(tag):
        kind = F.lower(_attribute(tag, "type"))
        relation = F.lower(F.element_at(F.split(F.trim(_attribute(tag, "rel")), r"\s+"), 1))
        typed = F.lit(False)
        for word in settings.FEED_TYPE_WORDS:
            typed = typed | F.contains(kind, F.lit(word))
        return F.contains(relation, F.lit("alternate")) & typed

    def suggests(href):
        hinted = F.lit(False)
        for word in settings.FEED_HREF_WORDS:
            hinted = hinted | F.contains(F.lower(href), F.lit(word))
        return hinted

    announced = F.transform(F.filter(tags(_LINK_TAG), announces), lambda t: _attribute(t, "href"))
    hrefs = F.transform(tags(_A_TAG), lambda t: _attribute(t, "href"))
    found = pages.select(
        *rest,
        decode_entities_each(announced).alias("_announced"),
        decode_entities_each(hrefs).alias("_hrefs"),
    ).withColumn(
        "_all", F.concat(F.filter("_announced", lambda h: h != ""), F.filter("_hrefs", suggests))
    )
    unique = F.array_distinct(F.transform("_all", lambda h: resolve_url(F.col(base), h)))
    return found.select(
        *rest, F.posexplode(F.slice(unique, 1, cap) if cap else unique).alias("feed_ord", "feed_url")
    ).withColumn("feed_ord", F.col("feed_ord").cast("bigint"))


def discovered_feeds(pages: DataFrame, base: str = "url", html: str = "html",
                     cap: int = settings.MAX_DISCOVERED_FEEDS) -> DataFrame:
    """The discovered feeds that are read: the first `cap`."""
    return feed_discovery(pages, base, html, cap=cap)
