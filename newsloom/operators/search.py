"""Fuzzy search over title, summary and content text.

A query of n words is compared with every run of n words of each field:
score = edit distance / query length, and a match needs score <= threshold.
This is our own definition; a browser matcher ranks differently.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import settings
from newsloom.functions.bind import bind, computed
from newsloom.functions.text import search_text, strip_ws
from newsloom.session import stored


def search_docs(items: DataFrame) -> DataFrame:
    """Items with the text form of their content."""
    return items.withColumn("content_text", search_text(F.col("content_html")))


def source_filter(items: DataFrame, source: str = "") -> DataFrame:
    """One source, or all for ''."""
    return items.where(F.col("source") == source) if source else items


def _runs(words: Column, n: int) -> Column:
    """Every run of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _best_distance(field: Column, query: str, bound: int) -> Column:
    """Smallest edit distance of any word run, NULL when none is within the bound."""
    n = len(query.split(" "))
    words = F.split(F.lower(strip_ws(field)), " ")
    # the words are split once, not once per run
    runs = words if n == 1 else bind(words, lambda w: _runs(w, n))
    near = F.filter(runs, lambda w: F.abs(F.length(w) - len(query)) <= bound)
    distances = F.transform(F.array_distinct(near), lambda w: F.levenshtein(w, F.lit(query), bound))
    return F.array_min(F.filter(distances, lambda d: d >= 0))


def fuzzy_search(docs: DataFrame, query: str, threshold: float = settings.SEARCH_THRESHOLD) -> DataFrame:
    """Matching rows with their score; a blank query returns every row.

    Row-local: no shuffle and no Python, whatever the size of the table.
    """
    q = " ".join(query.lower().split())
    if not q:
        return docs.withColumn("score", F.lit(0.0))
    bound = math.floor(threshold * len(q))
    fields = [_best_distance(F.col(c), q, bound) for c in _FIELDS]
    scored = computed(docs, docs.columns, {"score": F.least(*fields) / F.lit(float(len(q)))})
    return scored.where(F.col("score").isNotNull())


_FIELDS = ("title", "summary", "content_text")

def _pieces(real: DataFrame) -> DataFrame:
    """q, n, size, k, i, shift, place, piece: the k + 1 pieces of each query, and where in a match each may stand."""
    cut = lambda i: F.floor(i * F.col("size") / (F.col("k") + 1)).cast("int")
    pieces = real.select("q", "n", "size", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).select(
        "*", cut(F.col("i")).alias("_from"), cut(F.col("i") + 1).alias("_to"))
    placed = pieces.select("*", F.explode(F.sequence(-F.col("i"), F.col("i"))).alias("shift"))
    return placed.select("q", "n", "size", "k", "i", "shift", (F.col("_from") + F.col("shift")).alias("place"),
                         F.substr("q", F.col("_from") + 1, F.col("_to") - F.col("_from")).alias("piece")).where("place >= 0")


def _index(runs: DataFrame, pieces: DataFrame) -> DataFrame:
    """n, r, place, piece: every part of a run that is as long as some piece of a query."""
    # one row per number of words and length
    lengths = F.broadcast(pieces.select("n", F.length("piece").alias("_long")).distinct())
    places = F.sequence(F.lit(0), F.length("r") - F.col("_long"))
    return runs.join(lengths, "n").where(F.length("r") >= F.col("_long")).select(
        "n", "r", "_long", F.explode(places).alias("place")).select(
        "n", "r", "place", F.substr("r", F.col("place") + 1, F.col("_long")).alias("piece"))


def _found_runs(docs: DataFrame, key: str, sizes: list) -> DataFrame:
    """key, n, r: the word runs of all fields that some query could match by its number of words and its length."""
    words = {f: F.split(F.lower(strip_ws(F.col(f))), " ") for f in _FIELDS}

    def some(n: int, low: int, high: int) -> Column:
        runs = lambda w: w if n == 1 else F.coalesce(_runs(w, n), F.array().cast("array<string>"))
        fitting = [F.filter(bind(words[f], runs), lambda r: F.length(r).between(low, high)) for f in _FIELDS]
        # texts are told apart by their hash, rows of n and text would be compared pair by pair
        return F.transform(F.array_distinct(F.concat(*fitting)), lambda r: F.struct(F.lit(n).alias("n"), r.alias("r")))

    runs = F.concat(*(some(row["n"], row["low"], row["high"]) for row in sizes))
    return docs.select(key, F.explode(runs).alias("_run")).select(key, "_run.n", "_run.r")


def search_many(docs: DataFrame, queries: DataFrame, query_id: str = "query_id", query: str = "query", key: str = "seq",
                threshold: float = settings.SEARCH_THRESHOLD) -> DataFrame:
    """query_id, key, score of every match of a whole table of queries: what fuzzy_search finds for each of them.

    An inverted index over the parts of the distinct word runs.  A query of
    bound k is cut into k + 1 pieces.  k edits leave some piece i whole that has
    i edits before it (counted from 0) and at most k - i behind, so a match has
    this piece, moved by i places at most, and what is behind it differs in
    length by k - i at most.  What meets is held to the distance.

    No documents are repeated per query; a blank query, which all documents
    match, is one row per document.  A null query is blank.
    """
    texts = queries.select(F.col(query_id), F.lower(strip_ws(F.col(query))).alias("q"))
    size, words = F.length("q"), F.size(F.split(F.col("q"), " "))
    asked = stored(texts.select("q").distinct().select(
        "q", words.alias("n"), size.alias("size"), F.floor(F.lit(threshold) * size).cast("int").alias("k")), "queries")
    real = asked.where(F.col("size") > 0)
    # one row per number of words in a query
    sizes = real.groupBy("n").agg(F.min(F.col("size") - F.col("k")).alias("low"), F.max(F.col("size") + F.col("k")).alias("high"))
    sizes = sizes.orderBy("n").collect()
    blank = docs.select(F.lit("").alias("q"), key, F.lit(0.0).alias("score"))
    if not sizes:
        return texts.where(F.col("q") == "").join(blank, "q").select(query_id, key, "score")
    found = _found_runs(docs, key, sizes)
    runs = stored(found.select("n", "r").distinct(), "runs")
    pieces = stored(_pieces(real), "pieces")
    longer = F.length("r") - F.col("size")
    met = _index(runs, pieces).join(pieces, ["n", "place", "piece"]).where(
        F.abs(longer - F.col("shift")) <= F.col("k") - F.col("i"))
    near = computed(met, ["q", "n", "r", "size", "k"], {"d": F.levenshtein("r", "q")}).where(F.col("d") <= F.col("k")).distinct()
    best = found.join(stored(near.select("q", "n", "r", "size", "d"), "near"), ["n", "r"]).groupBy("q", key).agg(
        F.min(F.col("d") / F.col("size").cast("double")).alias("score"))
    if asked.where(F.col("size") == 0).count():
        best = best.unionByName(blank)
    return texts.join(best, "q").select(query_id, key, "score")


def search_rank_order() -> list[Column]:
    """Best match first, ties in arrival order."""
    return [F.col("score"), F.col("seq")]


def search(docs: DataFrame, query: str, source: str = "") -> DataFrame:
    """What a reader sees for a query and a source."""
    return fuzzy_search(source_filter(docs, source), query).orderBy(*search_rank_order())
