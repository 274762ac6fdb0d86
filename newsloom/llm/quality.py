"""Quality rules on documents, and verdicts on the hosts they come from.

Counts are taken per document; failures are then summed per host, and each
host's failure rate is shrunk towards the mean of all hosts by a beta prior
that is fitted to the hosts themselves.  Documents of a host whose shrunk rate
is above the bound go, beside those that fail the base rules.

Defined results.  A null text is the empty text, with no words.  A null host
is a host of its own.  Repeated rows count as often as they occur and each
keeps its own verdict.  An empty table gives an empty table.  Only the named
columns are read, so further columns and their names do not matter.  Texts may
be of any length; work and memory per document are linear in its words, but
for sorting the windows of a document that repeats one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.bind import computed
from newsloom.llm.common import BLANKS, named, stored, text_of, words_of
from newsloom.operators.skew import fits_broadcast, lookup_join
from newsloom.session import materialise

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules; all rates are shares."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_symbol_percent: int = 10     # symbols per 100 word characters; judged per host only
    max_host_rate: float = 0.5       # a host above it goes, for any rule


def _covered(at: Column, window: int) -> Column:
    """Words covered by windows that start at the ascending positions `at`."""
    following = F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(F.element_at(at, -1) + window))
    widths = F.zip_with(at, following, lambda a, b: F.least(b - a, F.lit(window)))
    return F.aggregate(widths, F.lit(0).cast("bigint"), lambda total, n: total + n)


def rule_counts(docs: DataFrame, keep: list[str], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """`keep` and the counts of each document (bigint), one row per row."""
    w, n = rules.window, F.size("_words")
    base = computed(docs.select(*keep, text_of(text).alias("_text")), keep, {
        "_words": words_of(F.col("_text")),
        "word_chars": F.length(F.translate("_text", BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"),
        "_lines": F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0),
    })
    starts = F.when(n >= w, F.sequence(F.lit(1), n - (w - 1))).otherwise(F.array().cast("array<int>"))
    kept = [*keep, "_words", "word_chars", "n_symbols"]
    hashed = computed(base, kept, {
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_hashes": F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, w))),
    })
    # equal windows have equal hashes: only a document with two equal hashes can repeat a window
    suspect = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    window = lambda i: F.struct(F.array_join(F.slice("_words", i, w), " ").alias("w"), i.alias("i"))
    sorted_windows = computed(hashed, [*kept, "n_dup_lines"], {
        "_spots": F.when(suspect, F.array_sort(F.transform(starts, window))),
    })
    same = lambda k, other: F.get("_spots", k)["w"].eqNullSafe(F.get("_spots", other)["w"])
    twice = F.filter(F.sequence(F.lit(0), F.size("_spots") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    found = computed(sorted_windows, [*kept, "n_dup_lines"], {
        "_at": F.when(F.size("_spots") > 0, F.array_sort(F.transform(twice, lambda k: F.get("_spots", k)["i"]))),
    })
    return found.select(
        *keep, n.cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size("_at") > 0, _covered(F.col("_at"), w)).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def base_failed(rules: Rules = Rules()) -> Column:
    """The base rules on the counts of a document."""
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def host_verdicts(counted: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """One row per host: documents, failures per rule, shrunk rates, and host_ok.

    The beta prior's mean is the rate over all documents; its weight follows
    from the variance of the host rates (method of moments), so hosts that are
    alike, or small, are moved far towards the mean.
    """
    failures = {
        "base": base_failed(rules),
        "symbols": 100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars"),
    }
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *(F.sum(fails.cast("bigint")).alias(f"n_{rule}") for rule, fails in failures.items()),
    )
    hosts = materialise(hosts)
    total = F.sum("n_docs")
    prior = hosts.agg(*(
        f.alias(f"{part}_{rule}") for rule in failures for part, f in (
            ("mean", F.sum(f"n_{rule}") / total),
            ("var", F.var_pop(F.col(f"n_{rule}") / F.col("n_docs"))),
        )
    ))
    verdict, ok = hosts.crossJoin(F.broadcast(prior)), F.lit(True)  # the prior is one row
    for rule in failures:
        mean, var = F.col(f"mean_{rule}"), F.col(f"var_{rule}")
        weight = F.when(var > 0, F.greatest(mean * (1 - mean) / var - 1, F.lit(1.0))).otherwise(F.lit(1.0))
        rate = (F.col(f"n_{rule}") + weight * mean) / (F.col("n_docs") + weight)
        verdict = verdict.withColumn(f"rate_{rule}", rate)
        ok = ok & (F.col(f"rate_{rule}") <= rules.max_host_rate)
    return verdict.select("host", "n_docs", *(f"{p}_{r}" for r in failures for p in ("n", "rate")), ok.alias("host_ok"))


def judged(counted: DataFrame, hosts: DataFrame, host: str, spread: str, rules: Rules = Rules()) -> DataFrame:
    """The counted rows with base_failed and kept; `spread` is the column hot hosts are salted by."""
    marked = F.concat(F.lit("="), F.col("host"))  # null is a host like any other
    dim = hosts.select(F.coalesce(marked, F.lit("")).alias("_host"), "host_ok")
    keyed = counted.withColumn("_host", F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")))
    joined = lookup_join(keyed, dim, "_host", spread, fits=fits_broadcast(dim))
    return joined.withColumn("base_failed", base_failed(rules)).withColumn(
        "kept", ~F.col("base_failed") & F.col("host_ok")).drop("_host", "host_ok")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
                  rules: Rules = Rules()) -> DataFrame:
    """Per document: id, counts, base_failed, kept."""
    renamed = docs.select(named(id_col).alias("_id"), named(host).cast("string").alias("_from"), named(text).alias("_t"))
    counted = materialise(rule_counts(renamed, ["_id", "_from"], "_t", rules))
    out = judged(counted, host_verdicts(counted, "_from", rules), "_from", "_id", rules)
    return out.select(F.col("_id").alias(id_col), *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", spread: str = "doc_id",
              rules: Rules = Rules()) -> DataFrame:
    """The whole rows of the documents that the rules keep."""
    whole = docs.select(F.struct(*map(named, docs.columns)).alias("_row"))
    keyed = whole.select("_row", F.col("_row")[text].alias("_t"), F.col("_row")[host].cast("string").alias("_from"),
                         F.col("_row")[spread].alias("_id"))
    counted = stored(rule_counts(keyed, ["_row", "_from", "_id"], "_t", rules), "quality")
    hosts = host_verdicts(counted, "_from", rules)
    return judged(counted, hosts, "_from", "_id", rules).where("kept").select("_row.*")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d
), win AS (
  SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r
), c AS (
  SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover ON w.r = cover.r
), f AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    100 * n_symbols > 10 * word_chars AS many_symbols FROM c
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS a, sum(many_symbols::INT) AS b FROM f GROUP BY source
), p AS (
  SELECT sum(a) / sum(n) AS ma, var_pop(a / n) AS va, sum(b) / sum(n) AS mb, var_pop(b / n) AS vb FROM h
), q AS (
  SELECT *, CASE WHEN va > 0 THEN greatest(ma * (1 - ma) / va - 1, 1) ELSE 1 END AS wa,
    CASE WHEN vb > 0 THEN greatest(mb * (1 - mb) / vb - 1, 1) ELSE 1 END AS wb FROM p
), v AS (
  SELECT source, (a + wa * ma) / (n + wa) <= 0.5 AND (b + wb * mb) / (n + wb) <= 0.5 AS ok FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
