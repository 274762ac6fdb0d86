"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document when the document holds at least `share`
of the item's distinct word shingles.  Items are partitioned by size (powers
of two); an item is sketched by its smallest shingle hashes, as many as its
size class needs: of more than (1 - share) x size shingles, at least one is in
every document that contains the item.  The sketches are looked up by the
hashes of all shingles of all documents, so the search misses nothing and its
work follows the documents, whatever their length.  A pair whose sketch
matches are too few for the share is let go; the rest are verified by exact
shingle containment on the words themselves.

Defined results.  Words are lower-cased [^\\x20\\x09-\\x0D]+.  An item of fewer
words than a shingle is one shingle of its own length; an item without words
is contained in nothing.  Null texts have no words.  Rows that share a doc_id
(null is an id) count as parts of one document, rows that share an item_id as
parts of one item, as in SQL; repeated rows change nothing.  without_items
judges each row alone instead, so no row goes for another's text.  Empty tables
give an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.bind import computed
from newsloom.llm.common import text_of, words_of
from newsloom.session import materialise

SHINGLE = 5
SHARE = 0.8
#: The sketch table (16 bytes a row) is broadcast up to this size; beyond it, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _shingles(words: Column, n: int, of) -> Column:
    """of(slice) of each run of n words."""
    size = F.size(words)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of(F.slice(words, i, n)))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def _hash(words: Column) -> Column:
    return F.xxhash64(words)


def _exploded(rows: DataFrame, lengths: list[int], of) -> DataFrame:
    """(id, shingle) for each distinct run of each length in a row's words."""
    runs = [_shingles(F.col("_words"), n, of) for n in lengths]
    return rows.select("id", F.explode(F.array_distinct(F.concat(*runs) if len(runs) > 1 else runs[0])).alias("shingle"))


def _worded(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    plain = rows.select(F.col(id_col).alias("id"), text_of(text).alias("_text"))
    return computed(plain, ["id"], {"_words": words_of(F.lower("_text"))})


def _item_shingles(benchmark: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """item, run length, shingle words; one row per distinct shingle of an item."""
    words = _worded(benchmark, id_col, text).where(F.size("_words") > 0)
    whole = lambda w: F.when(F.size(w) < n, F.array(_joined(w))).otherwise(_shingles(w, n, _joined))
    return words.select(
        F.col("id").alias("item"), F.least(F.size("_words"), F.lit(n)).alias("run"),
        F.explode(F.array_distinct(whole(F.col("_words")))).alias("shingle"),
    ).distinct()


def _sketches(shingles: DataFrame, share: float) -> DataFrame:
    """item, run, size, h: the smallest hashes of each item, and how many of them must be found."""
    sized = shingles.groupBy("item").agg(
        F.count(F.lit(1)).alias("size"),
        F.array_sort(F.collect_list(F.struct(F.xxhash64(F.split("shingle", " ")).alias("h"), "run"))).alias("_all"),
    )  # an item is one row: its shingles are as many as its words
    largest = F.pow(F.lit(2), F.floor(F.log2("size")) + 1) - 1  # of the size class
    spare = lambda size: size - F.ceil(size * share - 1e-9)  # noqa: E731  what a match may lack
    width = F.least(F.col("size"), spare(largest) + 1).cast("int")
    return sized.select("item", "size", width.alias("width"), (width - spare(F.col("size"))).alias("least"),
                        F.inline(F.slice("_all", 1, width)))


def contained_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE,
                    share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_shared, n_item (bigint): every item that a document contains."""
    shingles = materialise(_item_shingles(benchmark, item_id, item_text, n))
    sketches = materialise(_sketches(shingles, share))
    lengths = sorted(r["run"] for r in sketches.select("run").distinct().collect()) or [n]  # 1 to n
    small = sketches.count() <= BROADCAST_ROWS
    bounded = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    words = _worded(docs, doc_id, doc_text)
    hits = _exploded(words, lengths, _hash).join(
        bounded(sketches.select("item", "least", F.col("h").alias("shingle"))), "shingle")
    likely = hits.groupBy("id", "item").agg(F.countDistinct("shingle").alias("found"), F.max("least").alias("least"))
    likely = materialise(likely.where(F.col("found") >= F.col("least")).select("id", "item"))
    # exact: the shingles themselves, of the documents that have a likely item
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  null is an id
    suspects = likely.select(key(F.col("id")).alias("_key")).distinct()
    text_rows = docs.select(key(F.col(doc_id)).alias("_key"), F.col(doc_id).alias("id"), F.col(doc_text).alias("_t"))
    few = likely.count() <= BROADCAST_ROWS
    suspects = F.broadcast(suspects) if few else suspects
    held = _exploded(_worded(text_rows.join(suspects, "_key", "left_semi"), "id", "_t"), lengths, _joined)
    pairs = held.join(bounded(shingles.select("item", "shingle")), "shingle").groupBy("id", "item").agg(
        F.countDistinct("shingle").alias("n_shared"))
    sizes = shingles.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).withColumnRenamed("item", "_item")
    same = F.col("item").eqNullSafe(F.col("_item"))
    return (
        pairs.join(bounded(sizes), same).where(F.col("n_shared") >= F.col("n_item") * share - 1e-9)
        .select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_item")
    )


def without_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole rows that contain no benchmark item.  Every row is judged alone, by every item row, whatever their ids."""
    key = lambda i, t: F.concat_ws("=", F.col(i).cast("string"), F.md5(text_of(t)))
    rows = docs.select(key(doc_id, text).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(key("item_id", "text").alias("item_id"), "text")
    found = materialise(contained_items(rows, items).select(F.col("doc_id").alias("_leak")).distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.join(found, key(doc_id, text) == found["_leak"], "left_anti")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), it AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS run, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)
), n AS (
  SELECT item_id, count(*) AS n_item FROM it GROUP BY item_id
), dt AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)
  UNION SELECT DISTINCT doc_id, array_to_string(w[i : i + run - 1], ' ')
  FROM (SELECT doc_id, w, run, unnest(range(1, len(w) - run + 2)) AS i FROM dw, (SELECT DISTINCT run FROM it WHERE run < 5))
)
SELECT doc_id, it.item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM dt JOIN it USING (s) JOIN n ON n.item_id IS NOT DISTINCT FROM it.item_id
GROUP BY doc_id, it.item_id HAVING count(*) >= any_value(n_item) * 0.8 - 1e-9
"""
