"""What the plans must look like, whatever the size of the data."""

import re

from conftest import SF_SMALL
from pyspark.sql import functions as F

from newsloom.catalog import acquisition, views as v
from newsloom.operators import acquire, cache, content, links, nodes, prune, robots, search, select
from newsloom.schemas import ROBOTS_RULES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", text)


def test_dedup_cuts_before_the_shuffle(spark):
    p = plan(select.deduplicate(v.items(spark, SF_SMALL)))
    assert p.count("WindowGroupLimit") == 2 and exchanges(p) == ["hashpartitioning"]


def test_feed_cap_cuts_before_the_shuffle(spark):
    p = plan(select.feed_cap(v.table(spark, SF_SMALL, "events"), "event_type", "event_id"))
    assert p.count("WindowGroupLimit") == 2


def test_top_up_cuts_before_the_shuffle(spark):
    p = plan(select.recent_or_topped_up(v.items(spark, SF_SMALL), v.policy(spark), v.AS_OF))
    assert "WindowGroupLimit" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_cap_is_a_top_k(spark):
    kept = v.items(spark, SF_SMALL).withColumns({"topup": F.lit(0), "src_first_seq": F.lit(0)})
    p = plan(select.cap_items(kept))
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_cache_joins_are_equi_joins(spark):
    readers, stored = v.cache_readers(spark, SF_SMALL), v.content_cache(spark, SF_SMALL)
    for df in (cache.cache_hits(readers, stored, v.AS_OF), cache.cache_misses(readers, stored, v.AS_OF)):
        p = plan(df)
        assert "NestedLoop" not in p and "Cartesian" not in p


def test_policy_join_does_not_shuffle_items(spark):
    assert exchanges(plan(select.with_policy(v.items(spark, SF_SMALL), v.policy(spark)))) == []


def test_robots_join_is_one_lookup(spark):
    rules = spark.createDataFrame([("h", "*", 0, 0, False, "/")], ROBOTS_RULES)
    p = plan(robots.robots_join(v.items(spark, SF_SMALL), rules))
    assert "NestedLoop" not in p and p.count("Join") == 1


def test_pages_are_tokenised_and_shuffled_once(spark):
    """One Python step and one exchange of nodes; every rule works on that partitioning."""
    pages = v.table(spark, SF_SMALL, "pages")
    for df in (content.block_content(pages), content.readable_content(pages), content.element_content(pages),
               prune.rebuild(prune.prune_nodes(nodes.html_nodes(pages, keep=["url"]), ["page_id"]), ["page_id"])):
        p = plan(df)
        assert p.count("MapInArrow") == 1 and exchanges(p) == ["hashpartitioning"]


def test_elements_are_built_for_pages_without_blocks_only(spark):
    p = plan(content.main_content(v.table(spark, SF_SMALL, "pages")))
    assert p.count("MapInArrow") == 1 and "LeftAnti" in p  # the blocks are read from their stored table


def test_feeds_are_parsed_once(spark):
    """Items and errors read the stored entries."""
    got = acquire.acquire(acquisition.registry(spark, SF_SMALL), acquisition.landed(spark, SF_SMALL))
    for df in (got.items, got.errors):
        assert "from_xml" not in plan(df) and "xmltostructs" not in plan(df).lower()


def test_a_cache_without_limit_is_not_sorted(spark):
    stored = v.content_cache(spark, SF_SMALL)
    assert "TakeOrdered" in plan(cache.cache_trim(stored, 10)) and "TakeOrdered" not in plan(cache.cache_trim(stored, None))


def test_links_and_search_do_not_shuffle(spark):
    assert exchanges(plan(links.feed_discovery(v.table(spark, SF_SMALL, "pages")))) == []
    assert exchanges(plan(links.page_links(v.table(spark, SF_SMALL, "pages")))) == []
    docs = v.table(spark, SF_SMALL, "documents").selectExpr("doc_id AS seq", "'' AS title", "source AS summary", "text AS content_text")
    p = plan(search.fuzzy_search(docs, "some words"))
    assert exchanges(p) == [] and "Python" not in p


def test_source_filter_reaches_the_scan(spark):
    events = v.table(spark, SF_SMALL, "events").selectExpr("event_id", "event_type AS source")
    p = plan(search.source_filter(events, "view"))
    assert "EqualTo(event_type,view)" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_date_filter_stays_above_dedup(spark):
    """Dedup comes first by rule: an older copy hides a fresher one."""
    p = plan(select.recent_items(select.deduplicate(v.items(spark, SF_SMALL)), v.policy(spark), v.AS_OF))
    assert p.index("recent_hours") < p.index("WindowGroupLimit")
