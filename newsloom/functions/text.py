"""Text functions.  All are Catalyst expressions except entity decoding."""

from __future__ import annotations

import html

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from newsloom import settings

# Java's \s is ASCII only: (?U) adds the Unicode blanks (and is much faster than
# the class written out), the range adds the information separators.
# Zero-width space is not a blank.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"

# Comments, elements whose text is not prose, declarations, then any tag.
# Attribute values may hold '>' inside quotes; possessive groups keep the
# matcher linear on long attributes.
_MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(script|style|template)\b.*?(?:</\1\s*>|\z)"
    r"|</?[a-z][^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>"
    r"|<[!?][^>]*>"
)


def strip_ws(c: Column) -> Column:
    """NULL becomes '', runs of Unicode blanks become one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _BLANKS, " "))


def make_id(c: Column) -> Column:
    """Stable 16-character id of a url."""
    return F.substring(F.sha1(F.coalesce(c, F.lit(""))), 1, 16)


@F.arrow_udf(T.StringType())
def _unescape(values: pa.Array) -> pa.Array:
    if not pc.any(pc.match_substring(values, "&")).as_py():
        return values
    return pa.array(
        [html.unescape(v) if v is not None and "&" in v else v for v in values.to_pylist()],
        pa.string(),
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape_all(lists: pa.Array) -> pa.Array:
    flat = lists.flatten()
    if not pc.any(pc.match_substring(flat, "&")).as_py():
        return lists
    decoded = [html.unescape(v) if v is not None and "&" in v else v for v in flat.to_pylist()]
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(sizes).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, pa.array(decoded, pa.string()))


def decode_entities_each(c: Column) -> Column:
    """decode_entities for every text of an array."""
    return _unescape_all(F.coalesce(c, F.array().cast("array<string>")))


def decode_entities(c: Column) -> Column:
    """Character references to characters (Arrow batches; no Catalyst form exists)."""
    return _unescape(c)


def strip_tags(c: Column) -> Column:
    """Markup out, entities left as they are."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _MARKUP, "")


def html_text(c: Column) -> Column:
    """Visible text of an HTML fragment; text nodes are joined without a separator."""
    return strip_ws(decode_entities(strip_tags(c)))


def summary_backfill(summary: Column, content_html: Column, max_chars: int = settings.SUMMARY_CHARS) -> Column:
    """An empty summary becomes the first characters of the content text."""
    lacks = (F.coalesce(summary, F.lit("")) == "") & (F.coalesce(content_html, F.lit("")) != "")
    # other rows pass NULL, so their content never reaches the entity decoder
    lead = F.substring(html_text(F.when(lacks, content_html)), 1, max_chars)
    return F.when(lacks, lead).otherwise(F.coalesce(summary, F.lit("")))


def truncate_html(c: Column, max_chars: int = settings.MAX_CONTENT_CHARS) -> Column:
    """Cut after max_chars characters and mark the cut."""
    body = F.coalesce(c, F.lit(""))
    cut = F.concat(F.substring(body, 1, max_chars), F.lit("…"))
    return F.when(F.length(body) > max_chars, cut).otherwise(body)


def xml_escape(c: Column) -> Column:
    """Escape the three characters that are not allowed in XML text."""
    amp = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rss_guid(url: Column, title: Column, pub_date: Column) -> Column:
    """Id of the url, or of the escaped title and date where there is no url."""
    no_url = F.coalesce(url, F.lit("")) == ""
    return F.when(no_url, make_id(F.concat(xml_escape(title), pub_date))).otherwise(make_id(url))


def search_text(c: Column) -> Column:
    """Content as text for the search index: each tag becomes one space."""
    return F.coalesce(F.regexp_replace(c, "<[^>]+>", " "), F.lit(""))


def tz_label(c: Column) -> Column:
    """Zone name without its file wrapper; each part is removed once."""
    label = F.coalesce(c, F.lit(""))
    opened = F.regexp_replace(label, r"^(.*?)tzfile\((.*)$", "$1$2")
    return F.regexp_replace(opened, r"^(.*?)\)(.*)$", "$1$2")
