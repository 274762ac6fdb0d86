"""Substring dedup: repeated runs of words are removed where they come again.

A window is WINDOW consecutive words.  A window goes when its words start
earlier in the corpus: in a document of a smaller id, or earlier in its own.

The reference is the corpus itself, so it is cut into shards in which equal
windows are sure to meet.  Of the runs of ANCHOR words in a window, the one of
least hash is its anchor; equal windows have equal anchors.  The windows that
follow each other with one anchor are a fragment.  Anchors that occur once
hold nothing that repeats.  Equal fragments are one reference fragment, at
their first place; every other place goes as a whole.  Reference fragments
that share an anchor with another are dealt to shards by anchor.  A shard's
suffix automaton is built in reference order, each state with its first place,
and the shard's fragments are streamed through it: the matching statistics,
cut at WINDOW words, give the first place of each window.

An anchor with more than CROWD reference fragments (a passage that the corpus
is full of, in many surroundings) is taken apart instead: its windows are
grouped by their words, with partial minima in every task.

`known_spans` streams documents against a given reference of bounded size,
whose automata are broadcast.

Defined results.  A null text has no words.  Ids that are null or occur twice
are allowed: rows are then ordered by id (nulls first) and text, and equal
rows are documents of their own, the first of which stays.  Empty tables give
empty tables.  Only the id and text columns are read.  Texts may be of any
length; work is linear in the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import per_batch, per_task, stored, text_of
from newsloom.operators.skew import distributed_rank
from newsloom.session import materialise

WINDOW = 20
ANCHOR = 8
CROWD = 2000
SHARD_WORDS = 200_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ in UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fragments(ws: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
    """Anchor hash, content hash, first window and number of windows of each fragment."""
    n = len(ws)
    if n < window:
        none = np.empty(0, np.int64)
        return none, none, none, none
    each = np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64)
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    runs = np.zeros(n - anchor + 1, np.uint64)
    for j in range(anchor):
        runs += each[j:n - anchor + 1 + j] * powers[j]
    runs = _mixed(runs)
    at = np.lib.stride_tricks.sliding_window_view(runs, window - anchor + 1).argmin(axis=1)
    at += np.arange(len(at))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    sums = np.r_[np.uint64(0), np.cumsum(each * powers)]
    back = np.full(n, _BACK, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    content = _mixed((sums[first + count + window - 1] - sums[first]) * back[first] + count.astype(np.uint64))
    return runs[at[first]].view(np.int64), content.view(np.int64), first, count


def _scan(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            parts = [fragments(words(t), window, anchor) for t in batch.column("text").to_pylist()]
            if parts:
                h, content, first, count = map(np.concatenate, zip(*parts))
                own = np.repeat(docs, [len(p[0]) for p in parts])
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (h, content, own, first.astype(np.int32), count.astype(np.int32)))),
                                                 ["anchor", "content", "doc", "first", "count"])

    return run


class Automaton:
    """Suffix automaton of several word sequences; a state knows where its words first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.place = [-1], [0], [None]

    @classmethod
    def of(cls, parts: dict) -> Automaton:
        """From the parts of another, as they are sent to workers."""
        made = cls()
        vars(made).update(parts)
        return made

    def _state(self, length, following, link, place) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state for the words of p followed by word, apart from the longer ones of q."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.place[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: Iterable, place) -> None:
        """Add a sequence; place(i) is what its i-th word is remembered by.  Earlier sequences keep their places."""
        last = 0
        for i, word in enumerate(sequence):
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0, place(i)), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def matches(self, sequence: Iterable, most: int):
        """At each word: the length of the longest match that ends there, cut at `most`, and where it first ended."""
        state, length = 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            if length > most:
                length = most
            while state and self.length[self.link[state]] >= length:
                state = self.link[state]
            yield length, self.place[state]


def _covered(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows at ascending starts."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def _shard_spans(rows: list[tuple[int, int, list[str]]], window: int):
    """rows (doc, first, words) of one shard: the word ranges that go."""
    automaton = Automaton()
    rows.sort(key=lambda r: r[:2])
    for number, (_, _, ws) in enumerate(rows):
        automaton.add(ws, lambda i, number=number: (number, i))
    for number, (doc, first, ws) in enumerate(rows):
        again = [
            first + i - window + 1 for i, (length, place) in enumerate(automaton.matches(ws, window))
            if length == window and (rows[place[0]][0], rows[place[0]][1] + place[1]) < (doc, first + i)
        ]
        for a, b in _covered(again, window):
            yield doc, a, b


def _stream_shards(window: int):
    """Rows sorted by shard; one shard is held at a time."""
    def run(batches):
        shard, held = None, []

        def done():
            spans = list(_shard_spans(held, window))
            return pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int32()),
                 pa.array([s[2] for s in spans], pa.int32())], ["doc", "a", "b"])

        for batch in batches:
            for key, doc, first, ws in zip(*(c.to_pylist() for c in batch.columns)):
                if key != shard:
                    if held:
                        yield done()
                    shard, held = key, []
                held.append((doc, first, ws.split(" ")))
        if held:
            yield done()

    return run


def _cut_words(window: int):
    """The words of the fragments that a document is asked for."""
    def work(batch):
        out = {"anchor": [], "crowded": [], "doc": [], "first": [], "words": []}
        for doc, text, asked in zip(batch["doc"], batch["text"], batch["asked"]):
            ws = words(text)
            for a in asked:
                out["anchor"].append(a["anchor"])
                out["crowded"].append(a["crowded"])
                out["doc"].append(doc)
                out["first"].append(a["first"])
                out["words"].append(b" ".join(ws[a["first"]:a["first"] + a["count"] + window - 1]).decode())
        return out

    return work


def _numbered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc (unique, in reference order), id, text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text).alias("text"))
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").isNull())
    if not twice.limit(1).count():
        return rows.select(F.col("id").alias("doc"), "id", "text")
    ranked = distributed_rank(rows, [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")], "doc")
    return ranked.select("doc", "id", "text")


def repeated_spans(numbered: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """doc, a, b: word ranges (end exclusive, may overlap) that go.  `numbered` has doc and text."""
    texts = numbered.select("doc", "text").where(F.col("doc").isNotNull())
    schema = "anchor bigint, content bigint, doc bigint, first int, count int"
    scan = texts.mapInArrow(_scan(window, anchor), schema)
    # written first, like the other tables that rows meet by a key: then both sides of the join are plain
    # shuffles, and Spark splits the rows of a hot key over tasks
    often = stored(scan.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    found = stored(scan.join(often, "anchor", "left_semi"), "fragments")
    distinct = stored(
        found.groupBy("anchor", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "first", "count")).alias("at")), "reference")
    # other places of a fragment
    copies = found.join(
        distinct.where("n > 1").select("anchor", "content", "at"), ["anchor", "content"]
    ).where((F.col("doc") != F.col("at.doc")) | (F.col("first") != F.col("at.first"))).select(
        "doc", F.col("first").alias("a"), (F.col("first") + F.col("count") + (window - 1)).alias("b"))
    # reference fragments that share their anchor
    shared = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared")
    asked = distinct.join(shared, "anchor").select(
        F.col("at.doc").alias("doc"), F.struct("anchor", (F.col("k") > crowd).alias("crowded"), F.col("at.first").alias("first"),
                                               F.col("at.count").alias("count")).alias("one"))
    asked = stored(asked, "asked")
    total = asked.agg(F.sum(F.col("one.count") + (window - 1)).alias("n")).first()["n"] or 0
    per_doc = asked.groupBy("doc").agg(F.collect_list("one").alias("asked"))
    cut = per_batch(
        texts.join(per_doc, "doc").select("doc", "text", "asked"), _cut_words(window),
        "anchor bigint, crowded boolean, doc bigint, first int, words string")
    shards = max(1, total // SHARD_WORDS)
    dealt = cut.where(~F.col("crowded")).select(
        F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "doc", "first", "words")
    streamed = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _stream_shards(window), "doc bigint, a int, b int")
    spans = copies.unionByName(streamed)
    if asked.where("one.crowded").limit(1).count():
        spans = spans.unionByName(_crowded_spans(cut.where("crowded"), window))
    return spans


def _crowded_spans(cut: DataFrame, window: int) -> DataFrame:
    """Windows grouped by their words: all but the first place go."""
    ws = F.split("words", " ")
    each = cut.select("doc", "first", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.array_join(F.slice(ws, i, window), " "))).alias("i", "w"))
    each = stored(each.select("doc", (F.col("first") + F.col("i")).alias("a"), "w"), "crowded")
    least = stored(
        each.groupBy("w").agg(F.min(F.struct("doc", "a")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
    return each.join(least, "w").where((F.col("doc") != F.col("at.doc")) | (F.col("a") != F.col("at.a"))).select(
        "doc", "a", (F.col("a") + window).alias("b"))


def _kept(batch):
    out = {"n_words": [], "n_removed": [], "kept": []}
    for text, spans in zip(batch["text"], batch["spans"]):
        ws = words(text)
        stay = np.ones(len(ws), bool)
        for s in spans or ():
            stay[s["a"]:s["b"]] = False
        kept = ws if stay.all() else [w for w, k in zip(ws, stay.tolist()) if k]
        out["n_words"].append(len(ws))
        out["n_removed"].append(len(ws) - len(kept))
        out["kept"].append(b" ".join(kept))
    return out


def _digested(batch):
    out = _kept(batch)
    out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in out.pop("kept")]
    return out


def _with_spans(docs: DataFrame, id_col: str, text: str, window: int, anchor: int, crowd: int) -> DataFrame:
    numbered = _numbered(docs, id_col, text)
    spans = repeated_spans(numbered, window, anchor, crowd).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    rows = numbered.where(F.col("doc").isNotNull()).join(spans, "doc", "left")
    return rows.select(F.col("id").alias("doc_id"), "text", "spans")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    def work(batch):
        out = _kept(batch)
        return out | {"kept": [k.decode() for k in out["kept"]]}

    return per_batch(_with_spans(docs, id_col, text, window, anchor, crowd), work,
                     "doc_id bigint, n_words bigint, n_removed bigint, kept string", reads=["text", "spans"])


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return per_batch(_with_spans(docs, id_col, text, window, anchor, crowd), _digested,
                     "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", reads=["text", "spans"])


def known_spans(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text: str = "text",
                ref_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
                most_words: int = 20 * SHARD_WORDS) -> DataFrame:
    """id, spans (array of a, b): maximal word ranges of at least `window` words that the reference holds.

    The reference must have at most `most_words` words, which is checked before
    anything is collected; its shards' automata are broadcast and every
    document is streamed through each.
    """
    size = reference.agg(F.sum(F.length(text_of(ref_text)) / 2 + 1).alias("n")).first()["n"] or 0
    if size > most_words:
        raise ValueError(f"a reference of up to {size:.0f} words is too large to broadcast")
    shards, held = [Automaton()], 0
    for row in reference.select(text_of(ref_text).alias("t")).toLocalIterator():
        ws = words(row["t"])
        if held and held + len(ws) > shard_words:
            shards.append(Automaton())
            held = 0
        shards[-1].add(ws, lambda i: i)
        held += len(ws)
    sent = docs.sparkSession.sparkContext.broadcast([vars(a) for a in shards])  # at most most_words words
    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text"))

    @per_task
    def work():
        automata = [Automaton.of(parts) for parts in sent.value]

        def step(batch):
            out = []
            for t in batch["text"]:
                ws, starts = words(t), set()
                for automaton in automata:
                    starts |= {i - window + 1 for i, (n, _) in enumerate(automaton.matches(ws, window)) if n == window}
                out.append([{"a": a, "b": b} for a, b in _covered(sorted(starts), window)])
            return {"spans": out}

        return step

    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<a: int, b: int>>"
    return per_batch(rows, work, schema, reads=["text"]).withColumnRenamed("id", id_col)
