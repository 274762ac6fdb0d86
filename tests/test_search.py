"""A table of queries against a loop over single ones."""

import functools
import random

from pyspark.sql import DataFrame, functions as F

from newsloom.operators import search


def test_search_many_is_a_loop_over_fuzzy_search(spark):
    rows = [(1, "Interest rates rise", "the bank, the bank", "Rates rose again; interest was paid"), (2, "Intrest", None, ""),
            (3, "Économie", "a b c", "économies d'échelle a b"), (4, "", "", None), (5, "rate", "rates", "raes  rise\nagain")]
    docs = spark.createDataFrame(rows, "seq bigint, title string, summary string, content_text string")
    texts = ["interest", "Rates  Rise", "a", "ab", "a b", "économie", "rates", "  ", None, "interest", "nothing like it at all",
             "the bank, the", "aaaa", "again"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    got = sorted((r.query_id, r.seq, round(r.score, 9)) for r in search.search_many(docs, queries).collect())
    want = sorted((i, r.seq, round(r.score, 9)) for i, t in enumerate(texts) for r in search.fuzzy_search(docs, t or "").collect())
    assert got == want and len({g[0] for g in got}) > 8


def test_search_many_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "b", "c")], "seq bigint, title string, summary string, content_text string")
    queries = spark.createDataFrame([(1, " "), (2, "zzzz")], "query_id int, query string")
    assert [tuple(r) for r in search.search_many(docs, queries.where("query_id = 1")).collect()] == [(1, 1, 0.0)]
    assert search.search_many(docs, queries.where("query_id = 2")).count() == 0
    assert search.search_many(docs, queries.limit(0)).count() == 0
    assert search.search_many(docs.limit(0), queries).count() == 0


def test_search_many_finds_matches_that_share_no_pair_of_characters(spark):
    """Texts of few characters, whatever the threshold: short queries may keep one character only."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    docs = spark.createDataFrame([(i, text(9), text(25), "xb " + text(40)) for i in range(30)],
                                 "seq bigint, title string, summary string, content_text string")
    texts = ["ab", *(text(n) for n in (2, 4, 7, 11))]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    for threshold in (0.3, 0.5):
        got = sorted((x.query_id, x.seq, round(x.score, 9)) for x in search.search_many(docs, queries, threshold=threshold).collect())
        loops = [search.fuzzy_search(docs, t, threshold).select(F.lit(i).alias("i"), "seq", "score") for i, t in enumerate(texts)]
        want = sorted((x.i, x.seq, round(x.score, 9)) for x in functools.reduce(DataFrame.unionAll, loops).collect())
        assert got == want and len(want) > 5


def test_runs_are_told_apart_without_comparing_rows(spark):
    """array_distinct compares structs pair by pair: a text of many words would take the square of its words."""
    docs = spark.createDataFrame([(1, "a", "b", "a a b")], "seq bigint, title string, summary string, content_text string")
    found = search._found_runs(docs, "seq", [{"n": 1, "low": 1, "high": 9}, {"n": 2, "low": 1, "high": 9}])
    assert sorted((x.n, x.r) for x in found.collect()) == [(1, "a"), (1, "b"), (2, "a a"), (2, "a b")]
    tree = found._jdf.queryExecution().analyzed().toString()
    assert tree.count("array_distinct(") == tree.count("array_distinct(concat(filter(") == 2
