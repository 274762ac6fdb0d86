"""Personal data: pattern spans, and terms that reveal the people behind them.

Emails, addresses, cards and phones found by pattern are the protected
entities.  The words of a document that holds an entity are its terms; over
the whole corpus their co-occurrence with an entity e estimates how much a term
t discloses:

    share(t, e) = w PMI(t, e) / IC(e),  PMI = log2(N n(t,e) / (n(t) n(e))),  IC = log2(N / n(e))

with N distinct texts, n(e) that hold e, n(t) that hold t, and n(t, e) that
hold both, wherever in the text.  A share of 1 means that t says as much as e
itself.  Small counts shrink the estimate: the first text proposes a pair, each
further one confirms it, and w = 1 - q^(n(t,e) - 1) with q = max(n(t), n(e)) / N
is the chance that not all further ones hold both by accident.  So two texts
are enough for a rare term and a rare entity, while one text proves nothing:
each of its words that is found nowhere else would say as much.  Terms above
`remove` are removed, above `generalise` generalised, at every place of every
document that holds e.

Defined results.  A null text is empty.  Repeated texts are counted once, and
get equal results; null ids are ids.  A word ends at blanks, punctuation and
pattern spans.  Counts run over all documents; an empty table gives an empty
table.  Only the id and text columns are read.  Texts may be of any length:
every pattern is linear in the text.  Counting is by partial sums, so a term or
an entity that fills the corpus is added up in every task first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from newsloom.llm import spans as sp
from newsloom.llm.common import per_batch, stored, text_of
from newsloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
METHOD_KINDS = ("remove", "generalise")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": "", "generalise": "[TERM]"}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that can start inside a run of digits can start at the run's start, so the lookbehind changes nothing
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = "\t\n\u000b\f\r"
_PLAIN_FROM = _UPPER + _PUNCTUATION + _BLANK
_PLAIN_TO = _UPPER.lower() + " " * (len(_PUNCTUATION) + len(_BLANK))
_PLAIN = str.maketrans(_PLAIN_FROM, _PLAIN_TO)
_TERM = re.compile(r"[^ ]+")


def _emails(text: str):
    """Leftmost non-overlapping emails: the longest name before each @ that has a domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and _LOCAL.match(text, start - 1, start):
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[sp.Span]:
    """The pattern spans of a text, ordered."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sp.ordered(found, KINDS)


def _entities(text: str, spans: list[sp.Span]) -> list[str]:
    """The distinct entities of a text."""
    found = set()
    for kind, start, end in spans:
        value = text[start:end].lower()
        value = value if kind in ("email", "ip") else "".join(filter(str.isdigit, value))
        found.add(f"{kind}:{value}")
    return sorted(found)


def _terms(text: str, spans: list[sp.Span]) -> dict[str, list[int]]:
    """The words between the spans, and where each starts."""
    found: dict[str, list[int]] = {}
    plain, at = text.translate(_PLAIN), 0
    for _, start, end in [*sorted(spans, key=lambda s: s[1]), ("", len(text), len(text))]:
        for m in _TERM.finditer(plain, at, max(at, start)):
            found.setdefault(m[0], []).append(m.start())
        at = max(at, end)
    return found


def _scan(batch):
    out = {"base": [], "entities": [], "terms": [], "cut": [], **{f"n_{k}": [] for k in KINDS}}
    for text in batch["text"]:
        spans = base_spans(text)
        terms = _terms(text, spans) if spans else {}
        whole = set(_TERM.findall(text.translate(_PLAIN))) if spans else set()
        out["base"].append(sp.joined(spans))
        out["entities"].append(_entities(text, spans))
        out["terms"].append([{"term": t, "starts": at} for t, at in terms.items()])
        out["cut"].append(" ".join(t for t in terms if t not in whole))
        for k in KINDS:
            out[f"n_{k}"].append(sum(s[0] == k for s in spans))
    return out


_SCANNED = (
    "id {id}, hash string, base string, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    + ", entities array<string>, terms array<struct<term: string, starts: array<int>>>, cut string"
)  # cut: the words that only the spans set apart
#: Tables of at most so many rows are broadcast.
BROADCAST_ROWS = 1_000_000


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _term_documents(texts: DataFrame) -> DataFrame:
    """term, n_term: the number of texts that hold each word of the corpus; a text counts `n` times, or once."""
    plain = F.translate("text", _PLAIN_FROM, _PLAIN_TO)
    words = F.array_distinct(F.array_remove(F.split(plain, " "), ""))
    n = F.col("n") if "n" in texts.columns else F.lit(1)
    return texts.select(F.explode(words).alias("term"), n.alias("n")).groupBy("term").agg(F.sum("n").alias("n_term"))


def _counted_once(texts: DataFrame, scanned: DataFrame) -> DataFrame:
    """text, n: rows whose n add up to one for each distinct text, and the words that spans set apart."""
    copies = materialise(scanned.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    repeated = texts.join(_bounded(copies), "hash").groupBy("hash", "_n").agg(F.first("text").alias("text"))
    return (
        texts.select("text", F.lit(1).cast("bigint").alias("n"))
        .unionByName(repeated.select("text", (1 - F.col("_n")).alias("n")))
        .unionByName(scanned.where("cut <> ''").groupBy("hash").agg(F.first("cut").alias("text")).select("text", F.lit(1).cast("bigint").alias("n")))
    )


def disclosing_terms(near: DataFrame, texts: DataFrame, n_docs: int, salts: int, generalise: float,
                     remove: float) -> DataFrame:
    """entity, term, kind: the terms whose share is above a threshold.

    `near` has row, entity, term: each distinct word of each distinct text that
    holds the entity, null for one without words.  A hot entity meets its terms
    in `salts` parts.
    """
    pairs = near.where(F.col("term").isNotNull()).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"))
    pairs = pairs.where("n_pair > 1")  # the others have no weight
    entities = near.groupBy("entity").agg(F.countDistinct("row").alias("n_entity"))
    parts = entities.select("entity", "n_entity", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    known = pairs.withColumn("salt", F.pmod(F.hash("term"), F.lit(salts))).join(parts, ["entity", "salt"]).join(
        _term_documents(texts), "term")
    n = F.lit(float(n_docs))
    pmi = F.log2(n * F.col("n_pair") / (F.col("n_term") * F.col("n_entity")))
    weight = 1 - F.pow(F.greatest("n_term", "n_entity") / n, F.col("n_pair") - 1)
    share = F.when(F.col("n_entity") < n_docs, weight * pmi / F.log2(n / F.col("n_entity"))).otherwise(0.0)
    kind = F.when(share >= remove, METHOD_KINDS[0]).when(share >= generalise, METHOD_KINDS[1])
    return known.select("entity", "term", kind.alias("kind")).where(F.col("kind").isNotNull())


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = 16,
             generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """Per document: id, n_email, n_ip, n_card, n_phone, base (joined spans) and method (array of spans)."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text")).withColumn("hash", F.md5("text"))
    scanned = per_batch(texts, _scan, _SCANNED.format(id=texts.schema["id"].dataType.simpleString()), reads=["text"])
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    held = scanned.where(F.size("entities") > 0)
    named = held.select("row", "hash", F.explode("entities").alias("entity"))
    # an entity of one text has no term of any weight; the others meet the words of their documents
    many = named.groupBy("entity").agg(F.min("hash").alias("_a"), F.max("hash").alias("_b")).where("_a <> _b").select("entity")
    shared = named.join(_bounded(materialise(many)), "entity").groupBy("row").agg(F.collect_list("entity").alias("_shared"))
    met = held.select("row", "hash", "terms").join(shared, "row")  # one document's entities
    first = met.groupBy("hash").agg(F.min("row").alias("row"))
    near = met.join(first.select("row"), "row", "left_semi").select("row", F.explode("_shared").alias("entity"), "terms")
    near = near.select("row", "entity", F.explode_outer("terms.term").alias("term"))
    n_docs = scanned.select("hash").distinct().count()
    flagged = materialise(disclosing_terms(near, _counted_once(texts, scanned), n_docs, salts, generalise, remove))
    # a word of two entities' documents is one span, under the stricter kind
    strict = F.when(F.min("rank") == 0, METHOD_KINDS[0]).otherwise(METHOD_KINDS[1])
    words = met.select("row", "_shared", F.explode("terms").alias("t"))
    words = words.select("row", F.explode("_shared").alias("entity"), "t.term", "t.starts")
    found = (
        words.join(_bounded(flagged), ["entity", "term"]).withColumn("rank", (F.col("kind") != METHOD_KINDS[0]).cast("int"))
        .groupBy("row", "term", "starts").agg(strict.alias("kind"))
        .select("row", "kind", F.length("term").alias("n"), F.explode("starts").alias("start"))
        .groupBy("row").agg(F.array_sort(F.collect_list(
            F.struct("start", (F.col("start") + F.col("n")).alias("end"), "kind"))).alias("method"))
    )  # one document's words
    return scanned.join(found, "row", "left").select(
        F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), "base",
        F.coalesce("method", F.array().cast("array<struct<start: int, end: int, kind: string>>")).alias("method"),
    )


def _digests(batch):
    base = [sp.parsed(x) for x in batch["base"]]
    method = [[(m["kind"], m["start"], m["end"]) for m in ms] for ms in batch["method"]]
    return {
        **{k: batch[k] for k in ("doc_id", *(f"n_{k}" for k in KINDS))},
        "base_sha256": [sp.digest(sp.joined(b)) for b in base],
        "spans": [sp.joined(sp.ordered(b + m, KINDS + METHOD_KINDS)) for b, m in zip(base, method)],
    }


def pii_digests(found: DataFrame) -> DataFrame:
    """The digest columns of find_pii's rows."""
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return per_batch(found, _digests, schema)


def sanitised(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The rows with their spans replaced in the text."""
    def work(batch):
        done = [sp.replaced(t or "", sp.parsed(s), MARKS) for t, s in zip(batch[text], batch[spans])]
        return {text: done}

    return per_batch(rows, work, rows.schema, reads=[text, spans])
