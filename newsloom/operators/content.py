"""Main content of a page: text blocks first, then the best scored element, then article, then main elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import settings
from newsloom.functions.bind import computed
from newsloom.functions.text import strip_ws, truncate_html, xml_escape
from newsloom.operators.nodes import is_element, packed_nodes, unpacked
from newsloom.operators.prune import in_order, node_markup, prune_nodes, rebuild
from newsloom.session import stored


def _joined(nodes: str, field: str, sep: str) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n[field]), sep)


_TEXT = ("ord", "tag", "text", "block", "in_link")
_MARKUP = ("ord", "kind", "before", "after", "text")
_SCORED = ("ord", "end_ord", "elem", "kind", "tag", "before", "after", "text", "block", "in_link", "parent", "grand")


def block_content(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                  min_chars: int = settings.MIN_CONTENT_CHARS) -> DataFrame:
    """(key, html, error): the text blocks of each page that are prose, or why the page cannot be read.

    Pages without enough prose have no row.
    """
    return _judged(pages, key, url, html, min_chars).where(F.col("html").isNotNull() | F.col("error").isNotNull()).select(
        key, "html", "error")


def _judged(pages: DataFrame, key: str, url: str, html: str, min_chars: int, alone: str | None = None) -> DataFrame:
    """(key, html, error, may_read): html and error as in `block_content`, for every page with a text.

    `may_read` is false if the page has no long block: `readable_content`
    counts no other text.
    """
    nodes = packed_nodes(pages, key, html, [url], _TEXT, texts=True, errors=True, leaves=alone)
    pruned = unpacked(prune_nodes(nodes, [key], url, also=F.col("tag") == "head"))
    failed = F.col("kind") == "error"
    # leaves are blocks without a text that counts
    grouped = pruned.where(F.col("kind").isin("text", "leaves") | failed).groupBy(key, "block").agg(
        F.max("tag").alias("tag"), F.max(F.when(failed, F.col("text"))).alias("error"),
        F.array_sort(F.collect_list(F.struct("ord", "text", "in_link"))).alias("nodes"),
    )
    parts = computed(grouped, [key, "tag", "nodes", "error"], {
        "ord": F.col("nodes")[0]["ord"],
        "block_text": strip_ws(_joined("nodes", "text", "")),
        "link_text": strip_ws(F.array_join(
            F.transform(F.filter("nodes", lambda n: n["in_link"]), lambda n: n["text"]), ""
        )),
    })
    heading = F.coalesce(F.col("tag").rlike("^h[1-6]$"), F.lit(False))
    long_enough = heading | (F.length("block_text") >= settings.BLOCK_MIN_CHARS)
    prose = F.length("link_text") <= settings.BLOCK_MAX_LINK_DENSITY * F.length("block_text")
    shown_tag = F.when(heading | F.col("tag").isin("li", "blockquote", "pre"), F.col("tag")).otherwise(F.lit("p"))
    block_html = F.concat(
        F.lit("<"), shown_tag, F.lit(">"), xml_escape(F.col("block_text")), F.lit("</"), shown_tag, F.lit(">")
    )
    good = (F.length("block_text") > 0) & long_enough & prose & F.col("error").isNull()
    shown = F.array_sort(F.collect_list(F.when(good, F.struct(
        "ord", block_html.alias("html"), F.col("block_text").alias("text")))))
    pages_of = parts.groupBy(key).agg(
        F.max("error").alias("error"), shown.alias("shown"),
        F.max(F.length("block_text") >= settings.BLOCK_MIN_CHARS).alias("may_read"),
    )
    whole = computed(pages_of, [key, "error", "shown", "may_read"], {"text": strip_ws(_joined("shown", "text", " "))})
    return whole.select(
        key, F.when(F.col("error").isNull() & (F.length("text") >= min_chars), _joined("shown", "html", "")).alias("html"),
        "error", "may_read")


def _words(c: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(c.rlike(f"(?i)(?:{'|'.join(words)})"), F.lit(False)).cast("int")


def readable_content(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                     min_chars: int = settings.MIN_CONTENT_CHARS, alone: str | None = None) -> DataFrame:
    """(key, html): the element whose paragraphs score best, with the neighbours that score well too.

    A paragraph is a block with enough text of its own.  It gives points to the
    element around it and half of them to the next one; tag and class of an
    element speak for or against it, and the share of links in its text takes
    away.  The best element of a page stays, with those of the same parent that
    reach a share of its score.  Pages whose kept paragraphs hold fewer than
    `min_chars` characters have no row, nor do paragraphs without an element
    around them.  All steps are windows over one partitioning by page.
    """
    so_far = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page, ends = Window.partitionBy(key), Window.partitionBy(key, "elem")
    block, target = Window.partitionBy(key, "block"), Window.partitionBy(key, "_target")
    packed = packed_nodes(pages, key, html, [url], _SCORED, leaves=alone)
    nodes = unpacked(prune_nodes(packed, [key], url, also=F.col("tag") == "head"))
    text = F.when(F.col("kind") == "text", strip_ws(F.col("text"))).otherwise(F.lit(""))
    sized = computed(nodes, nodes.columns, {
        "_chars": F.when(F.col("kind") == "leaves", F.col("chars")).otherwise(F.length(text)),
        "_commas": F.regexp_count(text, F.lit("[,;，、]")),
    })

    def held(c: Column) -> Column:
        return F.max(F.sum(c).over(so_far)).over(ends) - F.min(F.sum(c).over(so_far)).over(ends)

    chars = F.sum("_chars").over(block)
    opens = (F.col("kind") == "open") & (F.col("ord") == F.col("block")) & ~F.col("tag").rlike("^h[1-6]$")
    prose = F.when(opens & (chars >= settings.BLOCK_MIN_CHARS), chars)
    # twice the points, so that half of them is a whole number
    points = F.when(prose.isNotNull(), 2 * (1 + F.sum("_commas").over(block) + F.least(F.floor(chars / 100), F.lit(3))))
    measured = sized.withColumns({
        "_prose": prose, "_points": points.cast("int"), "_held": held(F.col("_chars")),
        "_links": held(F.when(F.col("in_link"), F.col("_chars")).otherwise(0)),
    })

    def gives(to: Column, n: Column) -> Column:
        return F.struct(to.alias("_target"), n.alias("_given"))

    own = gives(F.col("ord"), F.lit(None).cast("int"))
    gifts = F.when(
        F.col("_points").isNotNull(),
        F.array(own, gives(F.col("parent"), F.col("_points")), gives(F.col("grand"), (F.col("_points") / 2).cast("int"))),
    ).otherwise(F.array(own))
    given = measured.select("*", F.inline(gifts)).withColumn("_sum", F.sum("_given").over(target)).where(
        F.col("_given").isNull())
    tags = F.create_map(*(F.lit(x) for pair in settings.READABLE_TAGS.items() for x in pair))
    weight = F.coalesce(F.element_at(tags, F.col("tag")), F.lit(0)) + settings.READABLE_CLASS_WEIGHT * (
        _words(F.col("class"), settings.READABLE_WORDS) - _words(F.col("class"), settings.UNREADABLE_WORDS))
    score = (F.col("_sum") + 2 * weight) * (1 - F.col("_links") / F.col("_held"))
    scored = given.withColumn("_score", F.when(F.col("_sum").isNotNull() & (score > 0), score))
    best = F.max(F.when(F.col("_score").isNotNull(), F.struct("_score", -F.col("ord"), "parent"))).over(page)
    root = (F.col("parent") == F.col("_best.parent")) & (
        F.col("_score") >= settings.READABLE_SIBLING * F.col("_best._score"))
    kept = scored.withColumn("_best", best).withColumn(
        "_reach", F.max(F.when(is_element() & root, F.col("end_ord"))).over(so_far)
    ).where(F.col("_reach") >= F.col("ord"))
    whole = kept.withColumn("_all", F.sum("_prose").over(page)).where(F.col("_all") >= min_chars)
    return rebuild(whole, [key]).select(key, "html")


def element_content(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                    min_chars: int = settings.MIN_CONTENT_CHARS, alone: str | None = None) -> DataFrame:
    """(key, html): the first article with enough text; main elements count only on a page without article."""
    nodes = packed_nodes(pages, key, html, [url], _MARKUP, leaves=alone, whole=True)
    page = Window.partitionBy(key)
    opened = F.when((F.col("kind") == "open") & (F.col("tag") == "article"), F.lit(1))
    mains = F.collect_set(F.when((F.col("kind") == "open") & (F.col("tag") == "main"), F.col("ord"))).over(page)
    own = F.when(
        F.coalesce(F.max(opened).over(page), F.lit(0)) == 1, F.array_except("within", mains)
    ).otherwise(F.col("within"))
    candidates = nodes.withColumn("within", own).withColumn("cand", F.explode("within"))
    whole = rebuild(unpacked(prune_nodes(candidates, [key, "cand"], url)), [key, "cand"])
    best = whole.where(F.length("text") >= min_chars).groupBy(key).agg(F.min(F.struct("cand", "html")).alias("best"))
    return best.select(key, F.col("best.html").alias("html"))


def main_content(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                 max_chars: int = settings.MAX_CONTENT_CHARS, min_chars: int = settings.MIN_CONTENT_CHARS) -> DataFrame:
    """(key, content_html, method, error): the first candidate with enough text.

    The block stage runs over all pages and is written once; the later stages
    read only the pages that the stages before them leave.  Each stage shuffles
    its pages once.  Pages without content give '' and no method; `error` says
    why a page cannot be read.
    """
    # the nodes of pages that share a key are mixed, one by one
    shared = stored(pages.groupBy(key).count().where("count > 1").select(key, F.lit(False).alias("_alone")), "shared")
    read = pages.select(key, url, html).join(shared, key, "left").withColumn("_alone", F.coalesce("_alone", F.lit(True)))
    judged = stored(_judged(read, key, url, html, min_chars, "_alone"), "blocks")
    blocks = judged.where(F.col("html").isNotNull() | F.col("error").isNotNull()).drop("may_read")
    left = stored(read.join(blocks.select(key), key, "left_anti"), "left")
    long_texts = left.join(judged.where(~F.col("may_read")).select(key), key, "left_anti")
    readable = stored(readable_content(long_texts, key, url, html, min_chars, "_alone"), "readable")
    elements = element_content(left.join(readable.select(key), key, "left_anti"), key, url, html, min_chars, "_alone")
    none = F.lit(None).cast("string")
    found = blocks.select(key, "html", F.when(F.col("error").isNull(), F.lit("blocks")).alias("method"), "error")
    for stage, method in ((readable, "readability"), (elements, "element")):
        found = found.unionByName(stage.select(key, "html", F.lit(method).alias("method"), none.alias("error")))
    return pages.select(key).join(found.withColumnRenamed("html", "content_html"), key, "left").withColumn(
        "content_html", truncate_html(F.col("content_html"), max_chars)
    )
