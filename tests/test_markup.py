"""Pruning rules on small pages, one case per rule."""

import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators import content, links, nodes, prune

KEYS = ["page_id"]


def pruned(spark, pages, fn):
    df = spark.createDataFrame([(i, "https://ex.org/a/b", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    out = prune.rebuild(fn(nodes.html_nodes(df, keep=["url"])), KEYS)
    got = {r.page_id: r.html for r in out.collect()}
    return [got.get(i, "") for i in range(len(pages))]


def drop(cond):
    return lambda n: nodes.drop_subtrees(n, KEYS, cond)


def test_rebuild_closes_what_is_open(spark):
    assert pruned(spark, ["<p>a<b>c<br>d</p>e &lt; &amp;", "x</p>y", "<P Class='a  b' href=\"/q?a=1&amp;b\">t</P>", "<i/>z"], lambda n: n) == [
        "<p>a<b>c<br/>d</b></p>e &lt; &amp;", "xy", '<p class="a  b" href="/q?a=1&amp;b">t</p>', "<i></i>z",
    ]


def test_tags_roles_classes(spark):
    assert pruned(spark, ["a<nav>b<p>c</p></nav>d<form>e</form>", "<title>t</title>x"], drop(prune.blocked_tag())) == [
        "ad", "<title>t</title>x",
    ]
    assert pruned(spark, ["<div role=BANNER>a<i>b</i></div>c", "<div role=note>a</div>"], drop(prune.blocked_role())) == [
        "c", '<div role="note">a</div>',
    ]
    assert pruned(spark, ["<p class='navy'>a</p>b<p class=NavBar>c</p>", "<p class=plain>a</p>"], drop(prune.blocked_class())) == [
        "b", '<p class="plain">a</p>',
    ]


def test_nested_blocked_containers(spark):
    assert pruned(spark, ["<nav>a<nav>b</nav>c</nav>d<nav>e</nav>f"], drop(prune.blocked_tag())) == ["df"]


def linky(spark, *pages):
    return pruned(spark, pages, lambda n: prune.drop_linky(n, KEYS))


def test_link_lists(spark):
    ten = "<ul>" + "<li><a>" + "word " * 60 + "</a></li>" * 1
    ten = "<ul>" + ("<li><a>" + "word " * 60 + "</a></li>") * 10 + "</ul>z"
    nine = "<ul>" + ("<li><a>" + "word " * 60 + "</a></li>") * 9 + "</ul>z"
    # five links and a text: 5 letters, 4 spaces, a space, and the rest
    short = "<div>" + "<a>x</a>" * 5 + "<p>" + "y" * 189 + "</p></div>z"
    enough = "<div>" + "<a>x</a>" * 5 + "<p>" + "y" * 190 + "</p></div>z"
    four = "<div>" + "<a>x</a>" * 4 + "</div>z"
    got = linky(spark, ten, nine, short, enough, four)
    assert got[0] == "z" and got[1] == nine and got[2] == "z" and got[3] == enough and got[4] == four


def test_inner_list_goes_outer_stays(spark):
    outer = "<div><p>" + "long text " * 30 + "</p><ul>" + "<a>x</a>" * 6 + "</ul></div>"
    assert linky(spark, outer)[0] == "<div><p>" + "long text " * 30 + "</p></div>"


def test_own_anchors_and_absolute_links(spark):
    assert pruned(spark, ['<a href="#x">top</a><a href="../y?a=1&amp;b=2">up</a><a>none</a><link href="/s">'],
                  lambda n: prune.absolutize(n, KEYS)) == [
        '<a href="https://ex.org/y?a=1&amp;b=2">up</a><a>none</a><link href="/s"/>'
    ]


def test_images_and_gate(spark):
    assert pruned(spark, ["a<img src=x>b"], drop(prune.image())) == ["ab"]
    df = spark.createDataFrame([(119,), (120,)], "n int").selectExpr("repeat('x', n) AS text", "'h' AS html")
    assert [r.html for r in prune.min_text_gate(df).orderBy(F.length("text")).collect()] == ["", "h"]


def extract(spark, *pages):
    df = spark.createDataFrame([(i, "https://ex.org/", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    return {r.page_id: (r.method, r.content_html) for r in content.main_content(df).collect()}


def test_main_content_cascade(spark):
    prose = "This sentence is long enough to be a block of prose, and there is more of it. " * 3
    words = "".join(f"<p>w{i} and more</p>" for i in range(12))
    got = extract(
        spark,
        f"<html><head><title>no</title></head><body><nav>{prose}</nav><p>{prose}</p><p>tiny</p></body></html>",
        f"<article>{words}</article><main>{words}</main>",
        f"<main>{words}</main>",
        f"<article>short</article><main>{words}</main>",
        "<p>short</p>", "", None,
        f"<article class='share'>{words}<article>{words}</article></article>",
        f"<body><p><a href='/x'>{prose}</a></p></body>",
    )
    assert got[0] == ("blocks", f"<p>{prose.strip()}</p>")
    assert got[1] == ("element", f"<article>{words}</article>")
    assert got[2] == ("element", f"<main>{words}</main>")
    assert got[3] == (None, "")  # main counts only without article
    assert got[4] == got[5] == got[6] == (None, "")
    assert got[7] == ("element", f"<article>{words}</article>")  # the outer one is refused by its class
    assert got[8] == (None, "")  # a paragraph that is one link is not prose


def test_readability_stage(spark):
    mostly = "<p><a href='/x'>" + "a headline that is long, " * 4 + "</a>" + "and what it is about, " * 3 + "</p>"
    shown = mostly.replace("'/x'", '"https://ex.org/x"')
    got = extract(
        spark,
        f"<body><div>{mostly * 3}</div><div class='comment'><p>{'one, two, three, ' * 4}</p></div></body>",
        f"<body><div>{mostly * 2}</div><section>{mostly}</section><div><p>no</p></div></body>",
        f"<body><div class='promo'>{mostly}</div><div class='story'>{mostly}</div></body>",
        f"<div>{mostly}<div><div>{mostly}</div></div></div>",
        mostly * 3, f"<div>{'<a href=x>' + 'link ' * 40 + '</a>'}</div>", f"<ul>{mostly}</ul>",
    )
    assert got[0] == ("readability", f"<div>{shown * 3}</div>")
    assert got[1] == ("readability", f"<div>{shown * 2}</div><section>{shown}</section>")
    assert got[2] == ("readability", f'<div class="story">{shown}</div>')
    assert got[3] == ("readability", f"<div>{shown}<div><div>{shown}</div></div></div>")
    assert got[4] == got[5] == (None, "")  # no element around; nothing but a link
    assert got[6] == ("readability", f"<ul>{shown}</ul>")


def test_page_links_on_untidy_markup(spark):
    page = """<!-- <a href="/no">no</a> --><script>'<a href="/no">no</a>'</script>
      <a data-href="/no" href='/one?x=1'>One &amp; <b>only</b></a><A HREF=/two>Two</A><a href="/three">Three<a name=q>none</a>
      <a href="/empty"> </a><a href="mailto:a@b">Mail</a><a title="a > b" href="four">Four</a>"""
    df = spark.createDataFrame([(1, "https://ex.org/d/", page)], "page_id int, url string, html string")
    got = [(r.title, r.url_out) for r in links.page_links(df).orderBy("entry_ord").collect()]
    assert got == [
        ("One & only", "https://ex.org/one"), ("Two", "https://ex.org/two"), ("Three", "https://ex.org/three"),
        ("Mail", "mailto:a@b"), ("Four", "https://ex.org/d/four"),
    ]


@pytest.mark.parametrize("selector, want", [
    (None, 4), ("a", 4), ("a[href^='/n/']", 1), ("a[href^='/n/'], a[href*='/n/']", 2), ('a[href*="zzz"]', 0), ("", 4),
    ("a[href^=/n/]", 1), ("a[href$='.pdf']", 1), ("[href=/y]", 1), ("a.news", 2), (".news.top", 1), ("a.news[href$=pdf], a[href='/y']", 2),
    ("a[href^='/x'][href$='2']", 1), ("h3 a", 0), ("a, h3 a", 0), ("div", 0), ("a:first-child", 0), ("a[title='x']", 0),
])
def test_selectors(spark, selector, want):
    page = """<a href="/n/1" class="news  top">a</a><a href="/x/n/2">b</a><a href="/y">c</a><a class='news' href="/z.pdf">d</a>"""
    df = spark.createDataFrame([(1, "https://ex.org/", page, selector)], "page_id int, url string, html string, s string")
    assert links.page_links(df, selector=F.col("s")).count() == want


def test_a_page_that_cannot_be_read_costs_only_itself(spark):
    prose = "This sentence is long enough to be a block of prose, and there is more of it. " * 3
    rows = [(1, "https://ex.org/", f"<p>{prose}</p>"), (2, "https://ex.org/", f"<p>{prose}<![foo[bar]]></p>"), (3, "u", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: (r.content_html, r.method, r.error) for r in content.main_content(df).collect()}
    assert got[1] == (f"<p>{prose.strip()}</p>", "blocks", None) and got[3] == ("", None, None)
    assert got[2][:2] == ("", None) and got[2][2].startswith("AssertionError")
    assert {r.page_id for r in nodes.html_nodes(df).collect()} == {1}


def test_nodes_come_in_bounded_batches(spark, monkeypatch):
    page = "<ul>" + "<li>x</li>" * 500 + "</ul>"
    df = spark.createDataFrame([(i, "u", page) for i in range(20)], "page_id int, url string, html string").coalesce(1)
    want = nodes.html_nodes(df, keep=["url"]).count()
    monkeypatch.setattr(nodes, "_CHUNK", 64)
    assert nodes.html_nodes(df, keep=["url"]).count() == want == 20 * (2 + 3 * 500)


def test_content_limits_are_parameters(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "some words here " * 10 + "</p>")], "page_id int, url string, html string")
    assert len(content.main_content(df, max_chars=50).first()["content_html"]) == 51
    assert content.main_content(df, min_chars=1000).first()["content_html"] == ""
    assert links.discovered_feeds(df, cap=1).count() == 0


def test_nodes_are_dealt_over_more_tasks_for_more_pages(spark, monkeypatch):
    """What one task sorts must not grow with the table."""
    monkeypatch.setattr(nodes, "_PART_BYTES", 1000)
    def tasks(n):
        df = spark.createDataFrame([(i, "u", "<p>" + "x" * 493 + "</p>") for i in range(n)], "page_id int, url string, html string")
        return prune.prune_nodes(nodes.html_nodes(df, keep=["url"]), ["page_id"]).rdd.getNumPartitions()

    assert (tasks(100), tasks(400)) == (50, 200)


PACKED = [
    "<article><p>one</p><p>two <b>three</b></p><nav>x</nav>&lt;four&gt;<br><!-- c --><script>a<b</script></article>tail <main>m</main>",
    "<div>" + "<a href='#t'>own</a><a href='/l'>l</a>" * 6 + "<p>" + "y" * 200 + "</p> \t </div><ul><li>q<li class=''>r</ul>",
    "<p>nul\0inside</p><h2 role=banner>b</h2><head><title>t</title></head><link href=x><i class=share>s</i><em>e",
    "<div><p></p></div><a>1</a>" * 7, "", "plain", None, "<p>" + "w</p><p>" * 300,
]


@pytest.mark.parametrize("run", [4096, 3])
def test_packed_nodes_are_pruned_as_single_ones(spark, monkeypatch, run):
    monkeypatch.setattr(nodes, "_RUN", run)
    df = spark.createDataFrame([(i, "https://ex.org/a/", p) for i, p in enumerate(PACKED)], "page_id int, url string, html string")
    plain = prune.prune_nodes(nodes.html_nodes(df, keep=["url"]), KEYS)
    packed = nodes.packed_nodes(df, "page_id", "html", ["url"], content._SCORED)
    back = nodes.unpacked(prune.prune_nodes(packed, KEYS))
    assert "inner" not in back.columns and packed.count() < nodes.html_nodes(df).count()

    def rows(found, *columns):
        shown = [F.coalesce(F.col(c), F.lit("")) if c in ("tag", "before", "after", "text") else F.col(c) for c in columns]
        return sorted(map(tuple, found.select("page_id", "url", "within", "href", *shown).collect()), key=str)

    assert rows(back, *content._SCORED) == rows(plain, *content._SCORED)
    texts = nodes.unpacked(prune.prune_nodes(nodes.packed_nodes(df, "page_id", "html", ["url"], content._TEXT, texts=True), KEYS))
    assert rows(texts.where("kind = 'text'"), *content._TEXT) == rows(plain.where("kind = 'text'"), *content._TEXT)


def test_words_that_are_paragraphs_are_not_shuffled_one_by_one(spark):
    """Three nodes a word made the shuffle many times as large as the pages."""
    page = "<body><article><p>" + "word</p><p>" * 3000 + "</p></article></body>"
    df = spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string")
    for fields, texts in ((content._TEXT, True), (content._MARKUP, False)):
        assert nodes.packed_nodes(df, "page_id", "html", ["url"], fields, texts).count() <= 10
    got = content.main_content(df).first()
    assert got.method == "element" and got.content_html.startswith("<article><p>word</p><p>word</p>")


LINKED = "<p><a href='/x'>" + "a headline that is long, " * 4 + "</a>" + "and what it is about, " * 3 + "</p>"
LEAVES = [
    *PACKED, "<article><p>" + "w</p><p>" * 200 + "</p>loose <p> two  words </p><p>a&amp;b</p><p>a>b</p><td>c</td><p>\n</p><p></p></article>",
    *(f"<body><main>{'<p>word</p>' * 80}<div>{'<a>x</a>' * 5}<p>{'y' * 20}</p><li>{'z' * n}</li><p>{' q ' * 3}</p>{'<p>four</p>' * 32}</div></main></body>"
      for n in range(8, 18)),
    "<article><template><p>raw</p><p>raw</p></template><script><p>x</p></script><!-- <p>c</p> -->" + "<p>one\u00a0two</p><p>R & D&&&</p><p>&lt&</p><p>&#65;&;</p>" * 30 + "</article>",
    "<article><a href='/l'>" + "<p>in a link</p>" * 40 + "</a><i title='<p>x</p>'>i</i><h2>head</h2><p>five <b>six</b></p></p></article>",
    f"<body><div>{LINKED * 2}<p>short</p><li>s</li>{LINKED}</div><section><p>no</p><p>yes</p></section></body>",
    f"<body><h3>Head</h3><p>short</p><p>{'a sentence that counts, ' * 8}</p><li>short</li><p>short</p><p>{'b' * 25}</p></body>",
    f"<body><div><a href='/y'>{'<p>linked, text</p>' * 30}</a>{LINKED}<p>{'s' * 24}</p><p>{'t' * 25}</p></div></body>",
]


def test_short_leaves_are_read_at_once(spark, monkeypatch):
    """A word as a paragraph cost three nodes in Python and in every stage; the content must be the same."""
    page = "<body><article><p>" + "word</p><p>" * 3000 + "</p></article></body>"
    assert len(nodes._nodes_of(page, leaves=True)) <= 10 and nodes._nodes_of(page)[-1][0] == nodes._nodes_of(page, True)[-1][0]
    df = spark.createDataFrame([(i, "https://ex.org/a/", p) for i, p in enumerate(LEAVES)], "page_id int, url string, html string")
    for fields, texts in ((content._TEXT, True), (content._SCORED, False)):
        read = df.where("html IS NOT NULL").withColumn("alone", F.lit(True))
        packed = nodes.unpacked(nodes.packed_nodes(read, "page_id", "html", ["url"], fields, texts, leaves="alone"))
        assert packed.where("kind = 'leaves' AND page_id = 8").agg(F.sum("pieces")).first()[0] == 202

    def found():
        return {r.page_id: (r.method, r.content_html, r.error) for r in content.main_content(df).collect()}

    got = found()
    monkeypatch.setattr(nodes, "_LEAVES", re.compile("(?!)"))
    assert got == found() and {m for m, _, _ in got.values()} == {None, "blocks", "readability", "element"}


def test_pages_that_share_a_key_are_mixed_node_by_node(spark):
    page = "<article>" + "<p>word</p><p>of</p>" * 40 + "</article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "u", page)], "page_id int, url string, html string")
    got = {r.page_id: (r.method, r.content_html) for r in content.main_content(df).collect()}
    twice = "<article><article>" + "<p><p>wordword</p></p><p><p>ofof</p></p>" * 40 + "</article></article>"
    assert got == {1: ("element", twice), 2: ("element", page)}


def test_long_blocks_of_a_repeated_page_count_as_often(spark):
    page = "<body><div><p>" + "forty letters, " * 2 + "some more.</p></div></body>"
    df = spark.createDataFrame([(1, "u", page)] * 2, "page_id int, url string, html string")
    assert {r.method for r in content.main_content(df).collect()} == {"readability"}


def test_html_nodes_of_no_pages(spark):
    df = spark.createDataFrame([(1, "u", None)], "page_id int, url string, html string")
    assert nodes.html_nodes(df).count() == nodes.html_nodes(df.limit(0)).count() == 0
