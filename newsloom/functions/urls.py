"""Url functions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.bind import bind

_SHOUTED = r"^(?=[A-Za-z])[a-z0-9+.\-]*[A-Z][A-Za-z0-9+.\-]*:"  # a scheme with a capital in it
_CONTROLS = "".join(chr(i) for i in range(0x21))  # blank and below
# scheme, authority, path, query of an address (generic URI syntax)
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
_HIERARCHICAL = ("http:", "https:", "ftp:", "file:")


def _tidy(u: Column) -> Column:
    """Leading blanks and controls out, tabs and newlines out, scheme in lower case."""
    bare = F.translate(F.ltrim(u, F.lit(_CONTROLS)), "\t\r\n", "")
    scheme = F.substring_index(bare, ":", 1)
    return F.when(
        bare.rlike(_SHOUTED), F.concat(F.lower(scheme), F.substr(bare, F.length(scheme) + 1))
    ).otherwise(bare)


def clean_url(u: Column) -> Column:
    """Address without query and fragment; NULL and '' stay as they are."""
    return F.substring_index(F.substring_index(_tidy(u), "#", 1), "?", 1)


def is_bad_url(u: Column) -> Column:
    """True where the authority holds an unusable bracketed host."""
    host = F.regexp_extract(_tidy(u), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    brackets = host.contains("[") | host.contains("]")
    sound = host.rlike(r"^(?:[^\[\]]*@)?\[(?:[0-9A-Fa-f]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?|v[0-9A-Fa-f]+\.[^\]]+)\](?::[0-9]*)?$")
    return F.coalesce(brackets & ~sound, F.lit(False))


def url_host(u: Column) -> Column:
    """Lower-case host and port of an address; '' where there is none."""
    return F.lower(F.regexp_extract(_tidy(u), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def url_path(u: Column) -> Column:
    """Path of an address, '/' where it is empty."""
    path = F.regexp_extract(_tidy(u), _PARTS, 3)
    return F.when(path == "", F.lit("/")).otherwise(path)


def _without_dots(path: Column) -> Column:
    """Apply '.' and '..' segments of an absolute path."""
    segments = F.split(F.substr(path, F.lit(2)), "/")

    def step(done, s):
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s == "..", parent).when(s == ".", done).otherwise(F.array_append(done, s))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    folder = F.element_at(segments, -1).isin(".", "..")
    full = F.when(folder, F.array_append(kept, F.lit(""))).otherwise(kept)
    joined = F.concat(F.lit("/"), F.array_join(full, "/"))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), joined).otherwise(path)


def _parts(u: Column) -> Column:
    """Scheme, authority, path, query and fragment, each with its delimiter."""
    def split(t):
        names = ("scheme", "host", "path", "query", "fragment")
        return F.struct(
            t.alias("all"), *(F.regexp_extract(t, _PARTS, i + 1).alias(n) for i, n in enumerate(names))
        )

    return bind(_tidy(u), split)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page `base`."""
    plain = href.rlike(r"^/(?![/.])[^?#\s]*$") & ~href.contains("/.") & base.rlike(r"^https?://[^/?#\s]+")
    quick = F.concat(F.regexp_extract(base, r"^https?://[^/?#]+", 0), href)
    pair = F.struct(_parts(base).alias("b"), _parts(href).alias("h"), href.alias("raw"))
    joined = bind(pair, lambda x: _join(x["b"], x["h"], x["raw"]))
    return F.when(plain, quick).otherwise(joined)


def _join(b: Column, h: Column, raw: Column) -> Column:
    def unless_bare(part, mark):
        return F.when(part == mark, F.lit("")).otherwise(part)

    relative = (h["scheme"] == "") | ((h["scheme"] == b["scheme"]) & h["scheme"].isin(*_HIERARCHICAL))
    query, fragment = unless_bare(h["query"], "?"), unless_bare(h["fragment"], "#")
    folder = F.regexp_replace(b["path"], r"[^/]*$", "")
    merged = F.regexp_replace(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h["path"]), r"/{2,}", "/"
    )
    target = F.when(h["path"].startswith("/"), h["path"]).otherwise(merged)
    on_site = F.concat(b["scheme"], b["host"], bind(target, _without_dots), query, fragment)
    same_page = F.concat(
        b["scheme"], b["host"], b["path"], F.when(query == "", b["query"]).otherwise(query), fragment
    )
    return (
        F.when(F.coalesce(h["all"], F.lit("")) == "", b["all"])
        .when((F.coalesce(b["all"], F.lit("")) == "") | ~relative, raw)
        .when(h["host"] != "", F.concat(b["scheme"], h["host"], h["path"], query, fragment))
        .when(h["path"] == "", same_page)
        .otherwise(on_site)
    )
