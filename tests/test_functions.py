import html
import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_blanks_are_python_blanks(spark):
    chars = [c for c in map(chr, range(1, 0x3001)) if not 0xD800 <= ord(c) < 0xE000]
    got = column(spark, [f"a{c}b" for c in chars], text.strip_ws)
    assert got == [re.sub(r"\s+", " ", f"a{c}b").strip() for c in chars]


def test_strip_ws_keeps_zero_width_space(spark):
    assert column(spark, ["\u200b\u200bImmi\u200b ", None, " \t\u00a0 ", "a \u2003\u0085 b"], text.strip_ws) == [
        "\u200b\u200bImmi\u200b", "", "", "a b",
    ]


DATES = {
    "Tue, 19 Aug 2025 10:10:24 +1000": "2025-08-19T10:10:24+10:00",
    "19 Aug 2025 10:10:24 GMT": "2025-08-19T20:10:24+10:00",
    "2025-08-14T19:02:25.100242+10:00": "2025-08-14T19:02:25.100242+10:00",
    "2025-08-14T19:02:25Z": "2025-08-15T05:02:25+10:00",
    "2025-08-14": "2025-08-14T00:00:00+10:00",
    "14 Aug 2025": "2025-08-14T00:00:00+10:00",
    "14 August 2025": "2025-08-14T00:00:00+10:00",
    "August 14, 2025 7:05 pm": "2025-08-14T19:05:00+10:00",
    "1/2/2025": "2025-01-02T00:00:00+10:00",
    "13/2/2025": "2025-02-13T00:00:00+10:00",
    "Thu, 14 Aug 2025 19:02 AEST": "2025-08-14T19:02:00+10:00",
    "12 Aug 2025 12:30 am": "2025-08-12T00:30:00+10:00",
    "19 Aug 25 10:10:24 GMT": "2025-08-19T20:10:24+10:00",
    "19 Aug 75": "1975-08-19T00:00:00+10:00",
    "2025-08-14T19:02:25+10": "2025-08-14T19:02:25+10:00",
    "20250814T190225Z": "2025-08-15T05:02:25+10:00",
    "20250814": "2025-08-14T00:00:00+10:00",
    "Thu Aug 14 19:02:25 2025": "2025-08-14T19:02:25+10:00",
    "Thu Aug 14 19:02:25 UTC 2025": "2025-08-15T05:02:25+10:00",
    "14 Aug 2025 7 pm": "2025-08-14T19:00:00+10:00",
    "14.08.2025": "2025-08-14T00:00:00+10:00",
    "August 14th, 2025": "2025-08-14T00:00:00+10:00",
    "the 3rd of Sept. 2025 at 7:05pm": "2025-09-03T19:05:00+10:00",
    "8/14/25": "2025-08-14T00:00:00+10:00",
    "8/14/25 10:30 PM +0000": "2025-08-15T08:30:00+10:00",
    "2025-08": "2025-08-01T00:00:00+10:00",
    "August 2025": "2025-08-01T00:00:00+10:00",
    "2025 Aug 14 10:30": "2025-08-14T10:30:00+10:00",
    "19-Aug-25 10:10:24 GMT": "2025-08-19T20:10:24+10:00",
    "19-Aug-2025": "2025-08-19T00:00:00+10:00",
    "2025-08-14T24:00:00": "2025-08-15T00:00:00+10:00",
    "2024-12-31 24:00 UTC": "2025-01-01T10:00:00+10:00",
    "2025-08-14T19:02:25,1234567-05:00": "2025-08-15T10:02:25.123456+10:00",
    "20250814190225": "2025-08-14T19:02:25+10:00",
    "2025-08-14T24:00:01": None, "14 Aug 2025 25:00": None, "14th 15th Aug 2025": None, "2025-08-14 yesterday": None,
    "2025-13-32": None, "14 Aug 7": None, "3rd": None, "2025": None, "August": None, "1/2/345": None, "14 Aug 2025 \n x;": None,
    "14 Aug 2025 7": None, "14 Aug 10:30": None,
    "30 Feb 2025": None, "junk": None, "": None, "10:30": None, None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Sydney"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(spark, list(DATES), lambda x: dates.to_iso(dates.parse_date_text(x)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == list(DATES.values())


def test_ambiguous_hour_takes_the_earlier_instant(spark):
    got = column(
        spark, ["2025-04-06 02:30"], lambda x: dates.to_iso(dates.parse_date_text(x, "Australia/Sydney"), "UTC")
    )
    assert got == ["2025-04-05T15:30:00+00:00"]


def test_standard_dates_mean_the_same_without_being_cut(spark, monkeypatch):
    texts = [
        "Tue, 19 Aug 2025 10:10:24 +1000", "Mon, 19 Aug 2025 23:59:59 GMT", " Fri, 31 Feb 2025 00:00:00 -0330 ", "Sun, 00 Jan 2025 01:02:03 +0000",
        "Tue, 19 Aug 2025 10:10:60 +1000", "Tue, 19 Aug 2025 24:00:00 GMT", "Tue, 19 Aug 2025 10:10:24 GMT\n", "Tue, 19 Aug 2025 10:10:24 +1000 x",
        "Wed, 01 Dec 0099 10:10:24 +1900", "2025-08-14T19:02:25Z", "2025-13-05T19:02:25Z", "2025-00-14T19:02:25+10:00", "2025-02-30T19:02:25-09:30",
        "2025-08-14T24:00:00Z", "2025-08-14T19:02:61Z", "2025-08-14T19:02:25Z\n", "2025-08-14T19:02:25+19:30", "0000-08-14T19:02:25Z", None, "",
    ]

    def found():
        return column(spark, texts, lambda x: F.unix_micros(dates.parse_date_text(x)))

    got = found()
    for name in ("_RFC_822", "_RFC_3339"):
        monkeypatch.setattr(dates, name, "(?!)")
    assert got == found() and sum(x is not None for x in got) >= 8


def test_rss_date_and_display(spark):
    when = dates.parse_date_text
    assert column(spark, ["2025-08-19T10:10:24+10:00"], lambda x: dates.rss_date(when(x), "2025-01-01")) == [
        "Tue, 19 Aug 2025 10:10:24 +1000"
    ]
    assert column(spark, [None], lambda x: dates.rss_date(when(x), "2025-01-01")) == ["Wed, 01 Jan 2025 10:00:00 +1000"]
    assert column(spark, ["2025-08-14T00:05:00+10:00", None], lambda x: dates.display_time(when(x))) == [
        "14 Aug, 12:05 am", "",
    ]


HREFS = [
    "/x", "x", "../x", "./x/./y/..", "//h/z", "#top", "?k=1", "http://o/p?q#r", "mailto:a@b", "javascript:void(0)",
    "", "../../../../z", "x//y", "/x//y", "HTTPS://Foo/Bar", "http:foo", "https:foo/bar", " /lead", "/a/../b/", "..",
    ".", "/a;p?x", "tel:+61", "a:b", "x#", "/.hidden", "/a.b", "/é?ü", "x?y=/../z",
]


@pytest.mark.parametrize("base", ["https://ex.org/a/b/c.html?q=1#f", "https://ex.org", "http://ex.org/d/"])
def test_resolve_url_is_the_library_rule(spark, base):
    got = column(spark, HREFS, lambda h: urls.resolve_url(F.lit(base), h))
    assert got == [urljoin(base, h) for h in HREFS]


URLS = [
    "http://A/b?c#d", "HTTP://a/b", "  http://x/y", "mailto:A@b?subject=1", "x", "", "http://[::1]/x",
    "http://a/\tb\nc", "http://a/b;p?q", "//h/p?x", "a]b", "http://h/[x]", "hTTp+x://q#f?g", "1A:b?c",
]


def test_clean_url_is_the_library_rule(spark):
    got = column(spark, URLS, urls.clean_url)
    assert got == [urlparse(u)._replace(query="", fragment="").geturl() if u else u for u in URLS]
    assert column(spark, got, urls.clean_url) == got
    assert column(spark, [None], urls.clean_url) == [None]


def test_bad_hosts(spark):
    bad = ["http://[bad/x", "http://a]b/", "http://[zz]/"]
    assert column(spark, bad, urls.is_bad_url) == [True] * 3
    assert not any(column(spark, URLS, urls.is_bad_url))


def test_html_text(spark):
    cases = {
        "<p>a &amp; b</p><script>x<y</script><!-- c --> 1 < 2 <a title='>'>q</a>": "a & b 1 < 2 q",
        "&lt;b&gt; <b>x</b>y": "<b> xy", "": "", None: "", "a<br>b": "ab", "<style>p{}": "",
    }
    assert column(spark, list(cases), text.html_text) == list(cases.values())


def test_entities_equal_the_library(spark):
    cases = ["&amp;lt;", "&copy &#233; &#x1F600; &notanentity; &", "plain", None]
    assert column(spark, cases, text.decode_entities) == [c and html.unescape(c) for c in cases]
    got = column(spark, [["&amp;", None, "x"], [], None], text.decode_entities_each, "array<string>")
    assert got == [["&", None, "x"], [], []]


def test_truncate_counts_characters(spark):
    long = "x" * 7999 + "😀"
    assert column(spark, [long, long + "y", None], text.truncate_html) == [long, long + "…", ""]


def test_xml_escape_and_ids(spark):
    assert column(spark, ["a<b>&amp;", None], text.xml_escape) == ["a&lt;b&gt;&amp;amp;", ""]
    assert column(spark, ["", None], text.make_id) == ["da39a3ee5e6b4b0d"] * 2
    assert column(spark, ["tzfile('X')", "UTC", None], text.tz_label) == ["'X'", "UTC", ""]
