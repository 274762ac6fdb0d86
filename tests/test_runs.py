"""Registry, cache, snapshots, acquisition, whole runs and streams."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from newsloom import session
from newsloom.operators import robots
from newsloom.operators.acquire import acquire, fetch_merge
from newsloom.operators.select import arrival_seq
from newsloom.plans.daily import Published, daily_run, publish
from newsloom.schemas import CONTENT_CACHE, LANDED_RESPONSES, ROBOTS_RULES
from newsloom.sinks import buckets, pointer, rss, snapshots, stats
from newsloom.sinks.cache import write_cache
from newsloom.sources import cache, feeds, pages, registry, snapshots as read
from newsloom.streaming import cache as stream_cache, counts as stream_counts, feeds as stream_feeds

CHANNEL = rss.Channel("News", "https://news.example.org/", "All of it")
NOW = dt.datetime(2025, 8, 19, 0, 10, 24, tzinfo=dt.timezone.utc)
CONFIG = {
    "timezone": "Nowhere/City",
    "sources": [
        {"name": "Fed", "feed": "https://fed.org/f", "recent_hours": 8760, "min_keep": 2},
        {"name": "Home", "homepage": "https://home.org/news", "selector": "a[href^='/n/']", "timeout": 45,
         "headers": {"Accept": "x", "N": 1}},
        {"name": "Fed", "recent_hours": None, "min_keep": 5},
        {"homepage": "https://lost.org/"},
    ],
}


def registry_of(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(CONFIG, indent=1))
    return registry.read_sources(spark, str(path))


def test_registry(spark, tmp_path):
    zone, table = registry_of(spark, tmp_path)
    rows = table.orderBy("source_ord").collect()
    assert zone == "Australia/Brisbane"
    assert [(r.name, r.timeout, r.feed_timeout, r.recent_hours, r.min_keep) for r in rows] == [
        ("Fed", 20, 20, 8760, 2), ("Home", 45, 45, 168, 0), ("Fed", 20, 20, 168, 5), ("Unknown Source", 20, 20, 168, 0),
    ]
    assert rows[1].headers == {"Accept": "x", "N": "1"}
    assert {r.source: (r.recent_hours, r.min_keep) for r in registry.policies(table).collect()}["Fed"] == (168, 5)


def test_yaml_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "config.yaml"
    path.write_text("timezone: Asia/Tokyo\nsources:\n  - name: A\n    feed: f\n")
    zone, table = registry.read_sources(spark, str(path))
    assert zone == "Asia/Tokyo" and table.first()["name"] == "A"


def test_cache_versions(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.read_cache(spark, path).count() == 0

    def rows(*items):
        return spark.createDataFrame([(u, c, NOW - dt.timedelta(days=d)) for u, c, d in items], CONTENT_CACHE)

    assert write_cache(spark, path, rows(("a", "old", 3), ("b", "old", 2))) == 0
    assert write_cache(spark, path, rows(("a", "new", 0), ("c", "new", 1)), limit=2) == 1
    got = {r.url: r.content_html for r in cache.read_cache(spark, path).collect()}
    assert got == {"a": "new", "c": "new"}
    write_cache(spark, path, rows(("d", "again", 0)), version=1)  # a repeated batch replaces its version
    assert {r.url for r in cache.read_cache(spark, path).collect()} == {"a", "b", "d"}


def document(*entries):
    return "<rss><channel>" + "".join(entries) + "</channel></rss>"


def item(n, link=None, title=None, date="19 Aug 2025 09:00:00 +1000"):
    link = f"https://fed.org/{n}?x=1" if link is None else link
    return f"<item><title>{title or f'T{n}'}</title><link>{link}</link><pubDate>{date}</pubDate><description>&lt;i&gt;S{n}&lt;/i&gt;</description></item>"


def landed(spark, rows):
    return spark.createDataFrame(rows, LANDED_RESPONSES)


def test_feed_rules(spark):
    long = document(*(item(i) for i in range(90)))
    mixed = document(item(1, link=""), item(2, title=" "), "<item><title>b <i></title></item>", item(3), item(3))
    cut = document(item(1))[:-40] + "<item><title>cut"
    df = spark.createDataFrame([("long", long), ("mixed", mixed), ("cut", cut), ("none", None)], "k string, body string")
    got = feeds.feed_entries(df)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"long": 80, "mixed": 2}
    warned = {r.k: (r.readable, r.corrupt, r.warned) for r in feeds.feed_warnings(df).collect()}
    assert warned == {"long": (80, 0, False), "mixed": (4, 1, True), "cut": (0, 2, True), "none": (0, 0, True)}


def test_entries_with_prefixes_and_end_tags_in_text(spark):
    body = (
        '<a:feed xmlns:a="x"><a:entry><a:title>A</a:title><a:link href="https://a.org/1"/><a:content type="html">&lt;p&gt;Body&lt;/p&gt;</a:content>'
        "<a:updated>2025-08-14T19:02:25Z</a:updated></a:entry></a:feed>"
    )
    cdata = document(
        "<item><title>B</title><link>https://b.org/1</link><description><![CDATA[x </item> y]]></description></item>",
        "<!-- <item><title>no</title><link>https://b.org/no</link></item> --><item><title>C</title><link>https://b.org/2</link>"
        "<content:encoded><![CDATA[<p>Long</p>]]></content:encoded><dcterms:created>2025-08-14</dcterms:created></item>",
    )
    rows = feeds.feed_entries(spark.createDataFrame([("p", body), ("c", cdata)], "k string, body string")).collect()
    got = {r.title: (r.url, r.summary, r.published_at is not None) for r in rows if r.title != "no"}
    assert got == {"A": ("https://a.org/1", "Body", True), "B": ("https://b.org/1", "x y", False), "C": ("https://b.org/2", "Long", True)}


def test_scanned_files_keep_prefixed_fields(spark, tmp_path):
    (tmp_path / "f.xml").write_text(document(
        "<item><title>A</title><link>https://a.org/1</link><dc:date>2025-08-14T19:02:25Z</dc:date>"
        "<content:encoded>text</content:encoded></item>"))
    row = feeds.scan_feed_files(spark, str(tmp_path)).first()
    assert row.published_at is not None and row.summary == "text"


def test_prefixed_and_permalink_entries(spark):
    body = (
        '<rdf:RDF><item rdf:about="x"><title>A</title><guid>https://a.org/1</guid><dc:date>2025-08-14T19:02:25Z</dc:date></item>'
        '<item><title>B</title><guid isPermaLink="false">id</guid></item></rdf:RDF>'
    )
    rows = feeds.feed_entries(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.title, r.url) for r in rows] == [("A", "https://a.org/1")] and rows[0].published_at is not None


def test_a_bad_address_fails_the_feed(spark, tmp_path):
    _, table = registry_of(spark, tmp_path)
    body = document(item(1), item(2, link="https://[bad/x"))
    got = acquire(table.where("source_ord = 0"), landed(spark, [("Fed", "feed", "u", 200, body, None)]))
    assert got.items.count() == 0
    assert [r.source for r in got.errors.collect()] == ["Fed"]


def run(spark, tmp_path):
    zone, table = registry_of(spark, tmp_path)
    home = "<html><body><a href='/n/1'>One</a><a href='/x'>No</a><a href='/n/2?y'>Two</a></body></html>"
    responses = landed(spark, [
        ("Fed", "feed", "https://fed.org/f", 200, document(item(1), item(2, date="1 Jan 2020"), item(3)), None),
        ("Home", "homepage", "https://home.org/news", 200, home, None),
        ("Unknown Source", "homepage", "https://lost.org/", None, None, "ReadTimeout"),
    ])
    old = spark.createDataFrame([("https://fed.org/1", "<p>cached</p>", NOW - dt.timedelta(days=14)),
                                 ("https://fed.org/3", "<p>stale</p>", NOW - dt.timedelta(days=15))], CONTENT_CACHE)
    rules = spark.createDataFrame([("home.org", "*", 0, 0, False, "/n/2")], ROBOTS_RULES)
    prose = "A sentence that is long enough to count as prose on this page. " * 4
    fetched = spark.createDataFrame(
        [("https://home.org/n/1", 200, f"<body><p>{prose}</p></body>", None),
         ("https://home.org/n/2", 200, f"<body><p>{prose}</p></body>", None),
         ("https://fed.org/3", 404, None, "HTTPError: 404"), ("https://other.org/", 200, "<p>x</p>", None)],
        "url string, status int, html string, error string",
    )
    return prose, daily_run(table, responses, old, rules, fetched, NOW, CHANNEL, zone)


def test_daily_run(spark, tmp_path):
    prose, out = run(spark, tmp_path)
    rows = {r.url: r for r in out.items.collect()}
    # policy of the last entry named Fed: 168 hours, at least 5, so the old item is added
    assert [r.url for r in sorted(rows.values(), key=lambda r: r["rank"])] == [
        "https://fed.org/1", "https://fed.org/3", "https://fed.org/2", "https://home.org/n/1", "https://home.org/n/2",
    ]
    assert rows["https://fed.org/1"].content_html == "<p>cached</p>"
    assert rows["https://home.org/n/1"].content_html == f"<p>{prose.strip()}</p>"
    assert rows["https://home.org/n/1"].summary == prose.strip()[:280]
    assert rows["https://home.org/n/2"].content_html is None  # refused by the rules
    errors = {(r.source, r.url, r.error) for r in out.errors.collect()}
    # the third source has neither feed nor homepage of its own but the name of the first
    assert ("Unknown Source", None, "ReadTimeout") in errors and ("Fed", "https://fed.org/3", "HTTPError: 404") in errors
    s = out.stats.first()
    assert s.articles_collected == 5 and s.cache_entries == 3 and s.errors == len(errors)


def test_landed_bodies_of_one_file_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Bodies take few bytes in a file, so the files of a table say little about the work in them."""
    monkeypatch.setattr(session, "_DEALT_BYTES", 16)
    fields = "source_ord long, name string, feed string, homepage string, selector string, fallback_statuses array<int>"
    table = spark.createDataFrame([
        (k, f"s{k}", "f" if k % 2 else None, None if k % 2 else f"https://s{k}.org/", None, []) for k in range(40)], fields)
    rows = [(f"s{k}", "feed", "f", 200, document(item(k)), None) if k % 2 else
            (f"s{k}", "homepage", "h", 200, f"<a href='/n/{k}?x#y'>L{k}</a>", None) for k in range(40)]
    landed(spark, rows).coalesce(1).write.parquet(str(tmp_path / "landed"))
    got = acquire(table, spark.read.parquet(str(tmp_path / "landed")))
    assert {r.url for r in got.items.collect()} == {
        f"https://fed.org/{k}" if k % 2 else f"https://s{k}.org/n/{k}" for k in range(40)}
    assert len([f for f in got.items.inputFiles() if "/entries-" in f]) > 1
    homes = got.items.where("url NOT LIKE 'https://fed%'")
    # by their bytes, so more than the shuffle partitions and cores of this session
    assert homes.select(F.spark_partition_id().alias("p")).distinct().count() > 8


@pytest.mark.parametrize("size, tasks", [(0, 8), (session._DEALT_BYTES * 20 + 1, 21)])
def test_tasks_follow_the_bytes(spark, size, tasks):
    assert session.dealt(spark.range(3), size, "id").rdd.getNumPartitions() == max(tasks, spark.sparkContext.defaultParallelism)


def test_documents(spark, tmp_path):
    _, out = run(spark, tmp_path)
    path = str(tmp_path / "latest")
    snapshots.write_envelope(out.envelope, path)
    doc = json.loads(spark.read.text(path).first()["value"])
    assert (doc["date"], doc["timezone"], doc["count"]) == ("2025-08-19", "Australia/Brisbane", 5)
    assert doc["generated_at"] == "2025-08-19T10:10:24+10:00"
    assert doc["items"][3]["published_at"] is None and "content_html" not in doc["items"][4]
    back = read.snapshot_items(read.read_envelope(spark, path))
    assert back.count() == 5
    text = out.rss.first()["value"]
    assert "<lastBuildDate>Tue, 19 Aug 2025 10:10:24 +1000</lastBuildDate>" in text and text.count("<item>") == 5


def test_empty_rss_and_missing_items(spark, tmp_path):
    none = spark.createDataFrame([], "rank long, title string, url string, summary string, published_at timestamp")
    lines = rss.rss_document(none, NOW, CHANNEL).first()["value"].split("\n")
    assert lines[-3:] == ["<lastBuildDate>Tue, 19 Aug 2025 10:10:24 +1000</lastBuildDate>", "</channel>", "</rss>"]
    (tmp_path / "s.json").write_text('{"date": "2025-08-19", "count": 0, "errors": [{"source": "a", "error": "e"}]}')
    assert read.snapshot_items(read.read_envelope(spark, str(tmp_path / "s.json"))).count() == 0
    assert stats.all_errors(spark.createDataFrame([("s", "e")], "source string, error string")).columns == ["source", "url", "error"]


@pytest.mark.parametrize("dedup", [stream_feeds.new_items, stream_feeds.new_items_within])
def test_stream_dedup_over_two_runs(spark, tmp_path, dedup):
    feeds_dir, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    feeds_dir.mkdir()
    seen = []
    for n, ids in enumerate([(1, 2, 2), (2, 3)]):
        (feeds_dir / f"{n}.xml").write_text(document(*(item(i) for i in ids)))
        entries = dedup(stream_feeds.stream_entries(spark, str(feeds_dir)))
        stream_feeds.append_to(entries, out, state).awaitTermination()
        seen.append(spark.read.parquet(out).count())
    assert seen == [2, 3]


def test_stream_dedup_has_a_state_partition_per_core(spark, tmp_path):
    """Every batch writes every partition of the state, so their number must not follow the session's."""
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    for given, want in ((4 * cores, cores), (2, min(2, cores))):
        feeds_dir, out, state = (tmp_path / f"{n}{given}" for n in ("in", "out", "state"))
        feeds_dir.mkdir()
        (feeds_dir / "0.xml").write_text(document(item(1), item(2), item(2)))
        spark.conf.set(name, str(given))
        try:
            entries = stream_feeds.new_items(stream_feeds.stream_entries(spark, str(feeds_dir)))
            query = stream_feeds.append_to(entries, str(out), str(state))
            assert spark.conf.get(name) == str(given)
        finally:
            spark.conf.set(name, before)
        query.awaitTermination()
        states = [s["numShufflePartitions"] for p in query.recentProgress for s in p["stateOperators"]]
        assert set(states) == {want} and spark.read.parquet(str(out)).count() == 2


@pytest.mark.parametrize("dedup", [stream_feeds.new_items, stream_feeds.new_items_within])
def test_stream_dedup_keeps_its_state_on_disk(spark, tmp_path, dedup):
    """A map in the heap is copied by every batch; a store that the session names is left alone."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    for given in (None, own):
        feeds_dir, out, state = (tmp_path / f"{n}{given is None}" for n in ("in", "out", "state"))
        feeds_dir.mkdir()
        if given:
            spark.conf.set(name, given)
        try:
            for n, ids in enumerate([(1, 2, 2), (2, 3)]):
                (feeds_dir / f"{n}.xml").write_text(document(*(item(i) for i in ids)))
                entries = dedup(stream_feeds.stream_entries(spark, str(feeds_dir)))
                stream_feeds.append_to(entries, str(out), str(state)).awaitTermination()
            assert spark.conf.get(name, None) == given
        finally:
            spark.conf.unset(name)
        kinds = {p.suffix for p in state.glob("state/0/*/*")} & {".changelog", ".delta"}
        assert kinds == {".delta" if given else ".changelog"} and spark.read.parquet(str(out)).count() == 3


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    landed_at, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(NOW + dt.timedelta(hours=7 * i), f"s{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "published_at timestamp, source string")
    for part in (df.limit(15), df.subtract(df.limit(15))):
        part.write.mode("append").parquet(landed_at)
        stream = spark.readStream.schema(df.schema).parquet(landed_at)
        stream_counts.stream_daily_counts(stream, out, state).awaitTermination()
    want = sorted(map(tuple, stream_counts.daily_counts(spark.read.parquet(landed_at)).collect()))
    assert sorted(map(tuple, stream_counts.read_daily_counts(spark, out).collect())) == want
    assert sum(r[2] for r in want) == 40 and spark.read.parquet(out).count() > len(want)  # some days came twice


def cached(spark, *items):
    return spark.createDataFrame([(u, c, NOW) for u, c in items], CONTENT_CACHE)


def test_a_damaged_cache_is_reported(spark, tmp_path):
    path = tmp_path / "cache"
    write_cache(spark, str(path), cached(spark, *((f"u{i}", "x" * 50) for i in range(200))))
    rows, errors = cache.sound_cache(spark, str(path))
    assert rows.count() == 200 and errors.count() == 0
    part = next((path / "version=0").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:100])
    next((path / "version=0").glob(f".{part.name}.crc")).unlink()
    with pytest.raises(Exception):
        cache.read_cache(spark, str(path)).collect()
    rows, errors = cache.sound_cache(spark, str(path))
    assert rows.count() == 0 and "cannot be read" in errors.first()["error"]


def test_a_run_is_published_over_a_damaged_cache(spark, tmp_path):
    _, out = run(spark, tmp_path)
    to = Published.under(str(tmp_path / "out"))
    write_cache(spark, to.cache, cached(spark, ("old", "x" * 50)))
    part = next((tmp_path / "out" / "cache" / "version=0").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:60])
    next(part.parent.glob(f".{part.name}.crc")).unlink()
    publish(out, to, NOW, time.time())
    assert cache.read_cache(spark, to.cache).count() == out.new_cache.count()
    assert spark.read.parquet(to.errors).where(F.col("error").contains("cannot be read")).count() == 1


def test_a_stream_on_a_stored_cache(spark, tmp_path):
    path, landed_at, state = (str(tmp_path / n) for n in ("cache", "in", "state"))
    write_cache(spark, path, cached(spark, ("a", "old"), ("b", "old")))
    write_cache(spark, path, cached(spark, ("b", "newer")))
    cached(spark, ("a", "new"), ("c", "new")).write.parquet(landed_at)
    stream = spark.readStream.schema(CONTENT_CACHE).parquet(landed_at)
    stream_cache.stream_cache_upsert(stream, path, state).awaitTermination()
    want = {"a": "new", "b": "newer", "c": "new"}
    assert {r.url: r.content_html for r in cache.read_cache(spark, path).collect()} == want
    assert cache.cache_versions(spark, path) == [1, 2]
    # a batch that is repeated finds its version
    assert stream_cache._version_of(spark, path, state, 0) == 2 and stream_cache._version_of(spark, path, state, 1) == 3
    assert stream_cache._version_of(spark, path, "another", 0) == 3


def test_an_empty_run_replaces_its_day(spark, tmp_path):
    items = spark.createDataFrame([(1, "t", "u", "", NOW, "s", None)],
                                  "rank long, title string, url string, summary string, published_at timestamp, source string, content_html string")
    path, errors = str(tmp_path / "daily"), str(tmp_path / "errors")
    snapshots.write_daily(items, path, "2025-08-17 00:00:00")
    snapshots.write_daily(items, path, "2025-08-18 00:00:00")
    assert read.latest_view(read.read_daily(spark, path)).count() == 1
    snapshots.write_daily(items.limit(0), path, "2025-08-18 00:00:00")
    daily = read.read_daily(spark, path)
    assert daily.count() == 1 and read.latest_view(daily).count() == 0
    failed = stats.all_errors(spark.createDataFrame([("s", "e")], "source string, error string"))
    for found in (failed, failed.limit(0)):
        stats.write_errors(found, errors, "2025-08-18")
    assert spark.read.parquet(errors).count() == 0


def test_one_response_of_several_counts(spark):
    prose = [f"A sentence number {n} that is long enough to count as prose on this page. " * 3 for n in range(2)]
    items = spark.createDataFrame([("u", "s", "", None)], "url string, source string, summary string, content_html string")
    fetched = spark.createDataFrame(
        [("u", 200, f"<p>{prose[0]}</p>", None), ("u", 200, f"<p>{prose[1]}</p>", None), ("u", None, None, "ReadTimeout")],
        "url string, status int, html string, error string")
    got = fetch_merge(items, fetched)
    assert got.items.first()["content_html"] in {f"<p>{p.strip()}</p>" for p in prose} and got.errors.count() == 0


@pytest.mark.parametrize("agent, refused", [("NewsBot/1.0", False), ("other", True), ("Bot/2 news", True), ("news/3", False)])
def test_the_first_named_group_decides(spark, agent, refused):
    rules = spark.createDataFrame(
        [("h.org", "news", 0, 0, True, "/a"), ("h.org", "newsbot", 1, 0, False, "/"), ("h.org", "*", 2, 0, False, "/a")], ROBOTS_RULES)
    items = spark.createDataFrame([(1, "https://h.org/a/1")], "seq long, url string")
    assert robots.robots_gate(items, rules, agent).count() == (0 if refused else 1)


def test_a_selector_that_is_not_understood_is_an_error(spark):
    config = [{"name": "Odd", "homepage": "https://o.org/", "selector": "h3 a"}, {"name": "Fine", "homepage": "https://f.org/"}]
    table = registry.with_defaults(registry.registry_from_rows(spark, config))
    page = "<h3><a href='/n/1'>One</a></h3>"
    got = acquire(table, landed(spark, [(n, "homepage", "u", 200, page, None) for n in ("Odd", "Fine")]))
    assert [r.source for r in got.items.collect()] == ["Fine"]
    assert [(r.source, r.error) for r in got.errors.collect()] == [("Odd", "selector not understood: h3 a")]


def test_arrival_has_room(spark):
    df = spark.createDataFrame([(7, 1), (8, 1)], "feed long, entry long")
    seq = arrival_seq(F.lit(0), F.lit(0), F.col("feed"), F.col("entry"))
    assert df.where("feed = 7").select(seq.alias("s")).first()["s"] == (7 << 30) + 1
    with pytest.raises(Exception, match="feed has no room"):
        df.select(seq.alias("s")).collect()


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_publish(spark, tmp_path):
    _, out = run(spark, tmp_path)
    to = Published.under(str(tmp_path / "out"))
    assert out.scratch
    publish(out, to, NOW, time.time() - 5)
    assert not set(out.scratch) & set(session.scratch_paths())
    assert spark.read.parquet(to.daily).count() == read.read_latest(spark, to.latest).count() == 5
    assert spark.read.text(to.rss).where("value = '<item>'").count() == 5
    assert spark.read.parquet(to.stats).first()["execution_time"] >= 5
    assert {r.url for r in cache.read_cache(spark, to.cache).collect()} == {"https://home.org/n/1"}


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a</p>\n<p>b</p>")
    rows = pages.read_page_files(spark, str(tmp_path)).collect()
    assert [r.html for r in rows] == ["<p>a</p>\n<p>b</p>"] and rows[0].page_id.endswith("a.html")


def test_faulty_entries_are_mended(spark):
    """The commonest faults cost nothing; what cannot be mended costs its own entry."""
    item = "<item><title>{}</title><link>{}</link><description>{}</description></item>"
    cases = [
        ("AT&T", "https://a.example.org/n?a=1&b=2", "one<br>two<hr class=x>three"),
        ("a&nbsp;&eacute;&hellip;b", "https://a.example.org/2", "x &unknown; y"),
        ("c\x0b&#8;&#x1F;d\x01", "https://a.example.org/3", "<![CDATA[R&D <br> &nbsp;&amp; more]]> & <![CDATA[<b>z</b>]]>"),
        ("bad <b>", "https://a.example.org/4", "lost"),
        ("fine &amp; &#233;", "https://a.example.org/5", "&lt;p&gt;as it is&lt;/p&gt;"),
    ]
    body = "<rss><channel>" + "".join(item.format(*c) for c in cases) + "</channel></rss>"
    docs = spark.createDataFrame([(body,)], "body string")
    got = [(r.entry_ord, r.title, r.url, r.summary) for r in feeds.feed_entries(docs).orderBy("entry_ord").collect()]
    assert got == [
        (0, "AT&T", "https://a.example.org/n", "one two three"),
        (1, "a é…b", "https://a.example.org/2", "x &unknown; y"),
        (2, "c d", "https://a.example.org/3", "R&D & more & z"),
        (4, "fine & é", "https://a.example.org/5", "as it is"),
    ]
    row = feeds.feed_warnings(docs).first()
    assert (row.readable, row.corrupt, row.repaired, row.warned) == (4, 1, 3, True)


def test_configured_numbers_may_be_text(spark):
    rows = registry.registry_from_rows(spark, [{"name": "a", "min_keep": "3", "timeout": "7", "fallback_statuses": ["403", 404]}])
    row = registry.with_defaults(rows).first()
    assert (row.min_keep, row.timeout, row.feed_timeout, row.fallback_statuses) == (3, 7, 7, [403, 404])
    with pytest.raises(ValueError, match="source b: min_keep"):
        registry.registry_from_rows(spark, [{"name": "b", "min_keep": "some"}])


def test_rule_without_a_path_allows(spark):
    items = spark.createDataFrame([(1, "https://a.org/x"), (2, "https://b.org/x"), (3, "https://c.org/x")], "seq bigint, url string")
    rules = spark.createDataFrame([("a.org", "*", 0, 0, False, ""), ("b.org", "*", 0, 0, False, None), ("c.org", "*", 0, 0, False, "/")],
                                  "host string, agent string, group_ord int, rule_ord int, allow boolean, path_prefix string")
    assert {r.seq: r.allowed for r in robots.robots_join(items, rules).collect()} == {1: True, 2: True, 3: False}


def test_a_writer_that_dies_leaves_the_run_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "latest")
    runs = [spark.range(n) for n in (3, 4, 5, 6)]
    pointer.replace_table(runs[0], path, day="a")
    folders = lambda: {p.name for p in (tmp_path / "latest").iterdir() if p.name.startswith("v-")}

    def dies(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # all files are there, the pointer is not moved
        m.setattr(pointer, "point_to", dies)
        with pytest.raises(KeyboardInterrupt):
            pointer.replace_table(runs[1], path)
    broken = runs[1].withColumn("x", F.expr("assert_true(id < 2)"))  # dies between its files
    with pytest.raises(Exception):
        pointer.replace_table(broken, path)
    assert pointer.read_table(spark, path).count() == 3 and pointer.read_manifest(spark, path)["day"] == "a"
    begun = pointer.read_table(spark, path)
    pointer.replace_table(runs[2], path)
    assert begun.count() == 3 and pointer.read_table(spark, path).count() == 5  # a reader that had begun goes on
    pointer.replace_table(runs[3], path)
    assert pointer.manifests(spark, path) == [1, 2] and pointer.read_table(spark, path).count() == 6
    assert pointer.read_manifest(spark, path, 1)["folder"] in folders()
    assert pointer.read_table(spark, str(tmp_path / "none"), "id bigint").count() == 0
    with pytest.raises(FileNotFoundError):
        pointer.read_table(spark, str(tmp_path / "none"))


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_batch_rewrites_the_buckets_of_its_urls(spark, tmp_path, monkeypatch):
    path, home = str(tmp_path / "cache"), tmp_path / "cache"
    rows = lambda ids, mark: spark.range(*ids).selectExpr(
        "concat('https://a.org/', id) AS url", f"concat('{mark}', id) AS content_html", "timestamp_seconds(id) AS fetched_at")
    read_back = lambda: {r.url: r.content_html for r in buckets.read_buckets(spark, path).collect()}
    assert read_back() == {} and buckets.merge_buckets(rows((0, 0), "x"), path) == []
    assert buckets.merge_buckets(rows((0, 500), "old"), path, "s", 0, buckets=64) == list(range(64))
    first = buckets.read_buckets(spark, path)
    before = files_of(home)
    touched = buckets.merge_buckets(rows((495, 505), "new"), path, "s", 1)
    assert 1 <= len(touched) <= 10
    want = {f"https://a.org/{i}": f"{'new' if i >= 495 else 'old'}{i}" for i in range(505)}
    assert read_back() == want and first.count() == 500  # a reader that had begun goes on
    now = files_of(home)
    assert before.items() <= now.items() and len(now) - len(before) == len(touched)
    assert buckets.merge_buckets(rows((495, 505), "again"), path, "s", 1) == [] and files_of(home) == now
    with monkeypatch.context() as m:
        m.setattr(buckets, "point_to", lambda *_, **__: 1 / 0)  # dies when all files are there
        with pytest.raises(ZeroDivisionError):
            buckets.merge_buckets(rows((0, 5), "lost"), path, "s", 2)
    assert read_back() == want
    buckets.merge_buckets(rows((0, 500), "newer"), path, "s", 2)
    assert buckets.merge_buckets(rows((0, 1), "last"), path, "t", 0) and read_back()["https://a.org/0"] == "last0"
    named = {f for k in pointer.manifests(spark, path) for f in pointer.read_manifest(spark, path, k)["buckets"].values()}
    assert {str(home.joinpath(f).relative_to(home).parent) for f in files_of(home)} == named


def test_first_arrival_by_index(spark, tmp_path):
    landed, out, index, check = (str(tmp_path / n) for n in ("landed", "out", "index", "check"))
    runs = [[("a", 2), ("b", 1), ("a", 3)], [("b", 4), ("c", 5)], [("a", 6), ("c", 7), ("d", 8), (None, 9)]]
    got = lambda: sorted((r.url or "", r.seq) for r in spark.read.parquet(out).collect())
    for run in runs:
        part = spark.createDataFrame([(u, s, "t", "") for u, s in run], "url string, seq bigint, title string, summary string")
        part.coalesce(1).write.mode("append").parquet(landed)
        stream_feeds.append_first_indexed(
            spark.readStream.schema(part.schema).parquet(landed), out, index, check, buckets=8).awaitTermination()
    assert got()[-4:] == [("a", 2), ("b", 1), ("c", 5), ("d", 8)]
    commits = sorted(p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # the last batch was not marked as done
        p.unlink(missing_ok=True)
    before = got()
    stream_feeds.append_first_indexed(
        spark.readStream.schema(part.schema).parquet(landed), out, index, check, buckets=8).awaitTermination()
    assert got() == before


def test_days_are_sealed_once(spark, tmp_path):
    landed, path, check = (str(tmp_path / n) for n in ("landed", "sealed", "check"))
    schema = "published_at timestamp, source string"
    runs = [["2024-01-01 10:00", "2024-01-02 09:00", "2024-01-01 23:59:59"], ["2024-01-01 12:00", "2024-01-04 00:00"],
            ["2024-01-01 13:00", "2024-01-06 12:00"], []]  # the third run's first row is too late
    for run in runs:
        part = spark.createDataFrame([(t, "s") for t in run] or [], "t string, source string").selectExpr(
            "CAST(t AS timestamp) AS published_at", "source")
        part.coalesce(1).write.mode("append").parquet(landed)
        stream_counts.stream_sealed_days(
            spark.readStream.schema(schema).parquet(landed), path, check, late="1 day").awaitTermination()
    sealed = stream_counts.read_sealed_days(spark, path)
    rows = lambda df: sorted((str(r.day)[:10], r.source, r.n) for r in df.collect())
    assert rows(sealed) == [("2024-01-01", "s", 3), ("2024-01-02", "s", 1), ("2024-01-04", "s", 1)]
    assert len(list((tmp_path / "sealed").rglob("*.parquet"))) == 3
    assert rows(stream_counts.open_days(spark.read.parquet(landed), sealed)) == [("2024-01-06", "s", 1)]
    none = stream_counts.read_sealed_days(spark, str(tmp_path / "none"))
    assert none.count() == 0 and stream_counts.open_days(spark.read.parquet(landed), none).count() == 4
