"""RSS and Atom documents to entries."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsloom import settings
from newsloom.functions.bind import compiled, computed
from newsloom.functions.dates import parse_date
from newsloom.functions.text import html_text, strip_ws
from newsloom.functions.urls import clean_url, is_bad_url

CORRUPT = "_corrupt"
_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
_LINK = T.StructType([
    T.StructField("_VALUE", T.StringType()),
    T.StructField("_href", T.StringType()),
    T.StructField("_rel", T.StringType()),
])
# Every field is text: dates must reach parse_date unread.
ENTRY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.ArrayType(_LINK)),
    T.StructField("guid", T.StructType([
        T.StructField("_VALUE", T.StringType()), T.StructField("_isPermaLink", T.StringType()),
    ])),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("issued", T.StringType()),
    T.StructField("modified", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_encoded", T.StringType()),
    T.StructField("dc_date", T.StringType()),
    T.StructField("dcterms_issued", T.StringType()),
    T.StructField("dcterms_modified", T.StringType()),
    T.StructField("dcterms_created", T.StringType()),
    T.StructField(CORRUPT, T.StringType()),
])
_ALL = (1 << 31) - 1
_PREFIXES = ("content_", "dc_", "dcterms_")
# the same fields as the XML reader names them, with their prefix
FILE_ENTRY = T.StructType([
    T.StructField(f.name.replace("_", ":", 1) if f.name.startswith(_PREFIXES) else f.name, f.dataType) for f in ENTRY
])
# one entry, up to its end tag, the next entry, or the end of a cut document; CDATA and comments are passed over
_ENTRY = (
    r"(?s)<((?:[A-Za-z_][\w.-]*:)?(?:item|entry))(?=[\s>])"
    r"(?:[^<]++|<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<(?!/?\1[\s>])(?!!\[CDATA\[|!--))*+(?:</\1\s*>)?"
)


#: Elements of HTML that have no end; `link` is a field of feeds.
_VOID = "area|base|br|col|embed|hr|img|input|source|track|wbr"
_XML_NAMES = ("amp", "lt", "gt", "quot", "apos")
_NO_XML = r"[\x00-\x08\x0E-\x1F\uFFFE\uFFFF]|&#(?:0*(?:[0-8]|1[1245-9]|2\d|3[01])|[xX]0*(?:[0-8bceBCEfF]|1[\da-fA-F]));"


def repaired(xml: Column) -> Column:
    """An entry with the commonest faults mended: bare ampersands, names of HTML, void tags, characters that XML forbids.

    A void tag becomes a blank: only the text of an entry is used.

    One pass per rule, whatever the text; CDATA is left as it is but for such characters.
    """
    named = F.create_map(*(F.lit(x) for n, c in sorted(name2codepoint.items()) if n not in _XML_NAMES for x in (n, chr(c))))

    def mended(text: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
        known = F.filter(names, lambda n: F.array_contains(F.map_keys(named), n))
        text = F.aggregate(known, text, lambda t, n: F.replace(t, F.concat(F.lit("&"), n, F.lit(";")), F.element_at(named, n)))
        text = F.regexp_replace(text, "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
        return F.regexp_replace(text, rf"(?i)</?(?:{_VOID})(?=[\s/>])[^<>]*>", " ")

    allowed = F.regexp_replace(F.regexp_replace(xml, r"[\x0B\x0C]", " "), _NO_XML, "")
    parts = F.split(allowed, r"(?=<!\[CDATA\[)|(?<=\]\]>)")
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("<![CDATA[")), p).otherwise(mended(p))), "")


def entry_texts(entry: Column) -> dict[str, Column]:
    """Address, title, summary and date texts of one parsed entry, as they are written."""
    links = F.coalesce(entry["link"], F.array().cast(T.ArrayType(_LINK)))
    texts = F.filter(F.transform(links, lambda x: F.trim(x["_VALUE"])), lambda v: v != "")
    main = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    hrefs = F.filter(F.transform(main, lambda x: x["_href"]), lambda v: v != "")
    # a permanent id stands in for a missing link
    perma = F.when(F.coalesce(entry["guid"]["_isPermaLink"], F.lit("true")) == "true", entry["guid"]["_VALUE"])
    blank = F.lit("")

    def first(*fields, otherwise=None):
        found = [F.nullif(entry[f], blank) for f in fields]
        return F.coalesce(*found, otherwise) if otherwise is not None else F.coalesce(*found)

    return {
        "_link": F.coalesce(F.get(texts, 0), F.get(hrefs, 0), perma, blank),
        "_title": entry["title"],
        "_summary": first("summary", "description", "content", "content_encoded", otherwise=blank),
        "_published": first("pubDate", "published", "issued", "dcterms_issued"),
        "_updated": first("updated", "dc_date", "modified", "dcterms_modified"),
        "_created": first("created", "dcterms_created"),
        "corrupt": F.coalesce(entry[CORRUPT].isNotNull(), F.lit(False)),
    }


def read_entry(parsed: DataFrame, keep: list[str], entry: Column, zone: str) -> DataFrame:
    """title, url, summary, published_at of parsed entries; corrupt and bad_url mark the unusable.

    A corrupt entry is mended and parsed once more; `repaired` marks those that are readable then.
    """
    broken = entry[CORRUPT]
    again = F.from_xml(_unprefixed(repaired(broken)), ENTRY, _PERMISSIVE)
    once = compiled(parsed, keep, {"_e": F.when(broken.isNull(), entry).otherwise(again), "_broken": broken.isNotNull()})
    texts = computed(once, [*keep, "_broken"], entry_texts(F.col("_e")))
    return compiled(texts, [*keep, "corrupt"], {
        "repaired": F.col("_broken") & ~F.col("corrupt"),
        "title": strip_ws(F.col("_title")),
        "url": clean_url(F.col("_link")),
        "bad_url": is_bad_url(F.col("_link")),
        "summary": html_text(F.col("_summary")),
        "published_at": parse_date(F.col("_published"), F.col("_updated"), F.col("_created"), zone),
    })


def usable() -> Column:
    """Readable, with a sound address and a title."""
    return ~F.col("corrupt") & ~F.col("bad_url") & (F.length("url") > 0) & (F.length("title") > 0)


def _unprefixed(xml: Column) -> Column:
    """Namespace prefixes to plain names: a fragment has lost their declarations.

    The prefix of the entry itself stands for no name at all.
    """
    own = F.regexp_extract(xml, r"^<([A-Za-z_][\w.-]*:)", 1)
    plain = F.when(own == "", xml).otherwise(F.regexp_replace(xml, F.concat(F.lit("(</?)"), own), F.lit("$1")))
    tags = F.regexp_replace(plain, r"(</?[A-Za-z_][\w.-]*):(?=[A-Za-z_])", "$1_")
    return F.regexp_replace(tags, r"(\s(?!xml:)[A-Za-z_][\w.-]*):(?=[\w.-]+\s*=\s*[\"'])", "$1_")


def read_entries(feeds: DataFrame, body: str = "body", zone: str = settings.DEFAULT_TIMEZONE,
                 cap: int = settings.MAX_FEED_ENTRIES, outer: bool = False) -> DataFrame:
    """First `cap` entries of each document, by position, readable or not.

    With `outer`, a document without any entry has one row without a position.

    Documents are cut into entries before parsing, so a malformed entry or a
    truncated document costs only itself; `corrupt` marks it.
    """
    rest = [c for c in feeds.columns if c != body]
    texts = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(_ENTRY), F.lit(0))
    cut = F.posexplode_outer if outer else F.posexplode
    pieces = feeds.select(*rest, cut(F.slice(texts, 1, cap)).alias("entry_ord", "_xml"))
    keep = [*rest, "entry_ord"]
    parsed = computed(
        pieces.withColumn("entry_ord", F.col("entry_ord").cast("bigint")), keep,
        {"_e": F.from_xml(_unprefixed(F.col("_xml")), ENTRY, _PERMISSIVE)},
    )
    return read_entry(parsed, keep, F.col("_e"), zone)


def feed_entries(feeds: DataFrame, body: str = "body", zone: str = settings.DEFAULT_TIMEZONE,
                 cap: int = settings.MAX_FEED_ENTRIES) -> DataFrame:
    """Usable entries: the cap counts positions first, then incomplete entries go."""
    return read_entries(feeds, body, zone, cap).where(usable()).drop("corrupt", "repaired", "bad_url")


def feed_warnings(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Per document, also one without any entry: entries read, read after mending, lost, and whether it is as it should be."""
    rest = [c for c in feeds.columns if c != body]
    ended = F.coalesce(F.col(body), F.lit("")).rlike(r"(?s)</(?:rss|feed|(?:\w+:)?RDF)\s*>\s*$")
    marked = feeds.withColumn("_ended", ended)
    entries = read_entries(marked, body, outer=True)
    real = F.col("entry_ord").isNotNull()
    counts = entries.groupBy(*rest, "_ended").agg(
        F.count_if(real & ~F.col("corrupt")).alias("readable"), F.count_if(real & F.col("corrupt")).alias("corrupt"),
        F.count_if(real & F.col("repaired")).alias("repaired"),
    )
    return counts.withColumn("warned", ~F.col("_ended") | (F.col("corrupt") + F.col("repaired") > 0)).drop("_ended")


def file_entry() -> Column:
    """The entry of a row that the XML reader made."""
    return F.struct(*(F.col(f"`{file.name}`").alias(f.name) for f, file in zip(ENTRY, FILE_ENTRY)))


def scan_feed_files(spark: SparkSession, path: str, row_tag: str = "item",
                    zone: str = settings.DEFAULT_TIMEZONE) -> DataFrame:
    """Landed feed files, one row per entry; files split over tasks.

    The reader gives up a file at its first fault: use scan_feed_documents for
    files that may not be well-formed, and read_entries on whole documents
    where the position of an entry matters.
    """
    raw = (
        spark.read.format("xml").schema(FILE_ENTRY)
        .options(rowTag=row_tag, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .load(path)
    )
    return read_entry(raw, [], file_entry(), zone)


def scan_feed_documents(spark: SparkSession, path: str, zone: str = settings.DEFAULT_TIMEZONE) -> DataFrame:
    """Landed feed files, one row per entry; a fault costs, or is mended in, its own entry only.

    A file is one text of a task, so files of one or a few feeds are meant.
    """
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    return read_entries(files, zone=zone, cap=_ALL)
