"""Secrets: pattern spans, and strings that a primed compressor finds new.

A candidate is a long string of key characters, other than words in a usual
case, in the line of a sensitive word or within `reach` characters of it.  It is
compressed by zstandard with a dictionary of usual identifiers and of the code
and text around it without its own copies; what it adds in bytes, per character, is its novelty.
Identifiers, paths and words of the surroundings cost little, keys cost nearly
as much as random strings of their alphabet and length.  Candidates that cost
at least `bound` of that are reported, at every place where they stand in the
document.

Defined results.  A null text is empty.  Every row is judged alone: repeated
rows get equal results, an empty table gives an empty table, null ids stay.
Only the id and text columns are read.  All patterns are linear in the text,
and what a candidate is measured against is bounded by `around` characters on
each side; a longer candidate is measured in pieces, and reported whole.
"""

from __future__ import annotations

import random
import re

import zstandard
from pyspark.sql import DataFrame, functions as F

from newsloom.llm import spans as sp
from newsloom.llm.common import per_batch, text_of

KINDS = ("assign", "access", "hex")
METHOD_KIND = "novel"
MARKS = {"assign": "[SECRET]", "access": "[SECRET]", "hex": "[SECRET]", METHOD_KIND: "[SECRET]"}

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(
    r"passw|passphrase|secret|token|api_?key|access_?key|private_?key|credential|bearer|authoriz|signature|client_?id",
    re.ASCII | re.IGNORECASE)
LEAST = 16
_WORDS = re.compile(r"[a-z]?(?:[+/_=-]++|[A-Z]?[a-z]{2,}+|[A-Z]+(?=[A-Z][a-z]|[+/_=-]|\Z)|[a-z](?=[+/_=-]|\Z))*+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret credential "
    "authorization bearer signature username user_name email address session cookie request response header "
    "content_type application json string integer boolean function return import export default const static "
    "public private protected class interface package module namespace include define struct config settings "
    "environment production development database connection localhost example hostname port timeout retry "
    "message exception error warning debug info value index length buffer encode decode base64 sha256 uuid "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"
)


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Key alphabets, the smallest first; the last holds all key characters.
ALPHABETS = [frozenset(a) for a in (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567=", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _UPPER + _LOWER, _DIGITS + _UPPER + _LOWER, _DIGITS + _UPPER + _LOWER + "+/_=-")]
_EXPECTED: dict[tuple[int, str, int], float] = {}  # at most one entry per alphabet and length up to `around`


def base_spans(text: str) -> list[sp.Span]:
    """The pattern spans of a text, ordered."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sp.ordered(found, KINDS)


def novelty(candidate: str, surroundings: str, identifiers: str = IDENTIFIERS, level: int = 9) -> float:
    """Bytes that the candidate adds to what the dictionary explains, per character."""
    primed = zstandard.ZstdCompressionDict(
        f"{identifiers} {surroundings} ".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_dict_id=False).compress
    return (len(pack(candidate.encode())) - len(pack(b""))) / len(candidate)


def _random_novelty(s: str) -> float:
    """The novelty of random strings of the same alphabet and length."""
    signs = next(a for a in ALPHABETS if a.issuperset(s))
    key = (len(signs), min(signs), len(s))
    if key not in _EXPECTED:
        rng, order = random.Random(repr(key)), sorted(signs)
        _EXPECTED[key] = sum(novelty("".join(rng.choices(order, k=len(s))), "") for _ in range(8)) / 8
    return _EXPECTED[key]


def _mixed(s: str) -> bool:
    """Digits among letters, or letters in no usual case: not words, which cost as much as keys."""
    letters = any(c.isalpha() for c in s)
    return letters and (any(c.isdigit() for c in s) or not _WORDS.fullmatch(s))


def _regions(text: str, reach: int):
    """The lines that hold sensitive words and `reach` characters on both sides of such a word; ordered, disjoint."""
    start = end = 0
    for word in _SENSITIVE.finditer(text):
        if word.end() + reach <= end:
            continue
        a = min(max(0, word.start() - reach), text.rfind("\n", end, word.start()) + 1 or end)
        b = text.find("\n", word.end())
        b = max(min(len(text), word.end() + reach), len(text) if b < 0 else b)
        if a > end:
            if end:
                yield start, end
            start = a
        end = b
    yield start, end


def _pieces(s: str, around: int):
    """A string itself; of one beyond `around`, overlapping pieces, and short ones that a key of 24 characters fills."""
    if len(s) <= around:
        yield s
        return
    for size, step in ((around, around // 2), (2 * LEAST, LEAST // 2)):
        for at in range(0, len(s) - size + step, step):
            yield s[at:at + size]


def _beside(text: str, start: int, end: int, around: int) -> str:
    """The text on both sides of a candidate, with all its other copies blanked."""
    own, n = text[start:end], end - start
    blank = " " * n  # of one length, so that a copy which the sides cut is blanked too
    left = text[max(0, start - around - n):start].replace(own, blank)[-around:]
    return left + " " + text[end:end + around + n].replace(own, blank)[:around]


def _everywhere(text: str, base: list[sp.Span], strings: set[str]) -> list[sp.Span]:
    """Every occurrence of the strings, the longest at each place; one pass, whatever their number."""
    heads: dict[str, list[str]] = {}
    for s in sorted(strings, key=len, reverse=True):
        heads.setdefault(s[:LEAST], []).append(s)
    found = []
    for run in _CANDIDATE.finditer(text) if heads else ():
        at = run.start()
        while at + LEAST <= run.end():
            own = next((s for s in heads.get(text[at:at + LEAST], ()) if text.startswith(s, at)), "")
            if own and sp.free(base, at, at + len(own)):
                found.append((METHOD_KIND, at, at + len(own)))
            at += len(own) or 1
    return found


def novel_spans(text: str, base: list[sp.Span], reach: int, around: int, bound: float) -> list[sp.Span]:
    """Candidates beside a sensitive word (its line, and `reach` characters) whose novelty is at the bound, wherever they stand."""
    found, regions = set(), _regions(text, reach)
    first, last = next(regions)
    for m in _CANDIDATE.finditer(text) if last else ():  # whole, however far it goes
        start, end = m.span()
        while last <= start and (region := next(regions, None)):
            first, last = region
        if start < last and first < end:
            if not sp.free(base, start, end):
                continue
            surroundings = _beside(text, start, end, around)
            if any(_mixed(p) and novelty(p, surroundings) >= bound * _random_novelty(p) for p in _pieces(m[0], around)):
                found.add(m[0])
    return _everywhere(text, base, found)


def _scan(reach: int, around: int, bound: float):
    def work(batch):
        out = {"id": batch["id"], "base": [], "spans": [], **{f"n_{k}": [] for k in KINDS}}
        for text in batch["text"]:
            base = base_spans(text)
            spans = base + novel_spans(text, base, reach, around, bound)
            out["base"].append(sp.joined(base))
            out["spans"].append(sp.joined(sp.ordered(spans, (*KINDS, METHOD_KIND))))
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
        return out

    return work


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", reach: int = 48, around: int = 256,
                 bound: float = 0.75) -> DataFrame:
    """Per document: id, base and spans (joined), n_assign, n_access, n_hex."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, base string, spans string, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    return per_batch(texts, _scan(reach, around, bound), schema).withColumnRenamed("id", id_col)


def secret_digests(found: DataFrame) -> DataFrame:
    """The digest columns of find_secrets' rows."""
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def without_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", reach: int = 48, around: int = 256,
                    bound: float = 0.75) -> DataFrame:
    """The rows with every secret replaced by a mark, and their length after it."""
    def work(batch):
        texts, sizes = [], []
        for value, size in zip(batch[text], batch[n_chars]):
            base = base_spans(value or "")
            spans = base + novel_spans(value or "", base, reach, around, bound)
            texts.append(sp.replaced(value, spans, MARKS) if spans else value)
            sizes.append(len(texts[-1]) if spans else size)
        return {text: texts, n_chars: sizes}

    return per_batch(docs, work, docs.schema, reads=[text, n_chars])
