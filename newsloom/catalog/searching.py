"""Fuzzy search over all documents, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import views as v
from newsloom.catalog.registered import register
from newsloom.operators import search, skew
from newsloom.session import materialise

_WORD = "treanch"
_PHRASE = "de lo que"


def docs(spark, sf):
    d = v.documents(spark, sf)
    return d.selectExpr(
        "doc_id AS seq", "'Doc ' || lang AS title", "source AS summary", "text AS content_text"
    )


def _sql_scores(query: str) -> str:
    n, size = len(query.split()), len(query)
    runs = " || ' ' || ".join(f"lead(w, {i}) OVER run" if i else "w" for i in range(n))
    # the SQL distance counts bytes; the queries are plain ASCII without '?', so one
    # byte for every other character keeps the distance
    def words(f):
        return f"string_split(regexp_replace(lower({v.sql_strip(f)}), '[^\\x00-\\x7F]', '?', 'g'), ' ')"

    fields = " UNION ALL ".join(
        f"SELECT seq, '{f}' AS field, unnest({words(f)}) AS w, generate_subscripts({words(f)}, 1) AS pos FROM docs"
        for f in ("title", "summary", "content_text")
    )
    return f"""
WITH docs AS (SELECT doc_id AS seq, 'Doc ' || lang AS title, source AS summary, text AS content_text FROM documents),
words AS ({fields}),
runs AS (SELECT seq, {runs} AS r FROM words WINDOW run AS (PARTITION BY seq, field ORDER BY pos)),
scores AS (SELECT seq, min(levenshtein(r, '{query}')) / {size}::DOUBLE AS score FROM runs WHERE r IS NOT NULL GROUP BY seq),
found AS (SELECT seq, score FROM scores WHERE score <= 0.3)"""


@register("fuzzy_search", f"{_sql_scores(_WORD)} SELECT seq, score FROM found")
def fuzzy_search(spark, sf):
    return search.fuzzy_search(docs(spark, sf), _WORD).select("seq", "score")


@register("fuzzy_search_phrase", f"{_sql_scores(_PHRASE)} SELECT seq, score FROM found")
def fuzzy_search_phrase(spark, sf):
    return search.fuzzy_search(docs(spark, sf), _PHRASE).select("seq", "score")


@register("search_rank", f"""
{_sql_scores(_WORD)} SELECT seq, row_number() OVER (ORDER BY score, seq) AS rank FROM found""")
def search_rank(spark, sf):
    # matches are few; ranking reads them twice
    found = materialise(search.fuzzy_search(docs(spark, sf), _WORD).select("seq", "score"))
    return skew.distributed_rank(found, search.search_rank_order()).select("seq", "rank")


@register("search_all", "SELECT doc_id AS seq FROM documents WHERE source = 'src3'")
def search_all(spark, sf):
    """A blank query returns every item of the source."""
    d = docs(spark, sf).withColumn("source", F.col("summary"))
    return search.search(d, "  ", "src3").select("seq")


# a reader's queries: the first word, and the first two, of each benchmark item, as far as they are plain ASCII
_QUERIES = "SELECT item_id * 2 + {n} - 1 AS query_id, {text} AS query FROM benchmark"
_FIRST = r"regexp_extract(text, '^([A-Za-z]{{3,}}) ([A-Za-z]+) ', {n})"


def _queries_sql() -> str:
    one, two = (_FIRST.format(n=n) for n in (1, 2))
    rows = " UNION ALL ".join(_QUERIES.format(n=n, text=text) for n, text in ((1, one), (2, f"{one} || ' ' || {two}")))
    return f"SELECT query_id, query FROM ({rows}) AS t WHERE trim(query) <> ''"


def _sql_many() -> str:
    def words(f):
        return f"string_split(regexp_replace(lower({v.sql_strip(f)}), '[^\\x00-\\x7F]', '?', 'g'), ' ')"

    fields = " UNION ALL ".join(
        f"SELECT seq, '{f}' AS field, unnest({words(f)}) AS w, generate_subscripts({words(f)}, 1) AS pos FROM docs"
        for f in ("title", "summary", "content_text"))
    return f"""
WITH docs AS (SELECT doc_id AS seq, 'Doc ' || lang AS title, source AS summary, text AS content_text FROM documents),
queries AS (SELECT query_id, lower(query) AS q, len(string_split(query, ' ')) AS n FROM ({_queries_sql()})),
words AS ({fields}),
runs AS (SELECT DISTINCT seq, 1 AS n, w AS r FROM words UNION ALL
  SELECT DISTINCT seq, 2, r FROM (SELECT seq, w || ' ' || lead(w) OVER (PARTITION BY seq, field ORDER BY pos) AS r FROM words) WHERE r IS NOT NULL),
near AS (SELECT q, a.n, r, levenshtein(r, q) / length(q)::DOUBLE AS score FROM (SELECT DISTINCT n, r FROM runs) a
  JOIN (SELECT DISTINCT q, n FROM queries) b ON a.n = b.n AND abs(length(r) - length(q)) <= 0.3 * length(q)
  WHERE levenshtein(r, q) <= floor(0.3 * length(q)))
SELECT query_id, seq, min(score) AS score FROM runs JOIN near USING (n, r) JOIN queries USING (q) GROUP BY query_id, seq"""


@register("search_many", _sql_many())
def search_many(spark, sf):
    """A whole table of queries at once."""
    v.table(spark, sf, "benchmark").createOrReplaceTempView("benchmark")
    return search.search_many(docs(spark, sf), spark.sql(_queries_sql()))
