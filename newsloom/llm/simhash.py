"""SimHash near-duplicates by an inverted index over byte positions.

A fingerprint is eight positional bytes.  Two fingerprints that differ in at
most four bits differ in at most four bytes, so a linked pair shares at least
eight minus four positional bytes: that is the count a pair must reach.  The
index keeps a list for every choice of that many positions and their bytes; a
pair meets in a list exactly when its tally of shared positional bytes reaches
the count, and is verified there on all its bits.

Lists are streamed in key order, so a task holds one list at a time.  A list
of more than LIST fingerprints is opened once more by the half bytes of the
positions that its key leaves: there at least four of eight are shared too,
and what remains are 16 bits, so no list has more than 65,536 fingerprints.
Of the links in a list only those that join something new go on.

Equal fingerprints are one entry of the index, whatever the number of their
documents; variants of one text can only fill the few million fingerprints
around its own.

Defined results.  A null text is empty; a text without words has fingerprint
zero and is linked like any other.  Rows that repeat are documents of their
own.  A null id is never a component's name; a component of null ids alone has
a null name.  Empty tables give empty tables.  Only the id and text columns are
read.  Texts may be of any length.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import named, per_batch, stored, text_of
from newsloom.llm.components import components
from newsloom.session import materialise

SHINGLE = 4
MAX_BITS = 4
LIST = 4096
_SEED = 42


def fingerprint(text: str, n: int = SHINGLE) -> int:
    """64 bits, each set when more than half of the shingle hashes set it."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    whole = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = max(0, min(n, len(words)) - 1)
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], _SEED) for a, b in zip(starts, ends[first:].tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * counts > len(hashes)).astype(object)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """Per document: id, fp (bigint, the 64 bits as a signed number)."""
    return _fingerprints(docs.select(named(id_col).cast("bigint").alias("id"), text_of(f"`{text}`").alias("text")), n)


def _fingerprints(texts: DataFrame, n: int) -> DataFrame:
    def work(batch):
        prints = np.array([fingerprint(t, n) for t in batch["text"]], np.uint64)
        return {"fp": prints.view(np.int64)}

    return per_batch(texts, work, f"id {texts.schema['id'].dataType.simpleString()}, fp bigint", reads=["text"])


def _unit(fp: Column, place: int, bits: int) -> Column:
    """The place-th group of bits."""
    return F.shiftrightunsigned(fp, place * bits).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(units: list[Column], bits: int, shared: int) -> Column:
    """One key for each choice of `shared` units: the number of the choice, then their values."""
    keys = []
    for number, choice in enumerate(itertools.combinations(range(len(units)), shared)):
        key = F.lit(number).cast("bigint")
        for place in choice:
            key = F.shiftleft(key, bits).bitwiseOR(units[place])
        keys.append(key)
    return F.array(*keys)


def _byte_keys(fp: Column, max_bits: int) -> Column:
    return _keys([_unit(fp, i, 8) for i in range(8)], 8, 8 - max_bits)


def _half_byte_keys(key: Column, fp: Column, max_bits: int) -> Column:
    """Keys over the half bytes of the positions that a list's key leaves.  A hash: lists that meet by chance are only longer."""
    choices = list(itertools.combinations(range(8), 8 - max_bits))
    left = F.array(*(F.array(*(F.lit(p) for p in range(8) if p not in c)) for c in choices))
    rest = F.get(left, F.shiftrightunsigned(key, 8 * (8 - max_bits)).cast("int"))
    halves = [
        F.call_function("shiftrightunsigned", fp, F.get(rest, F.lit(i // 2)) * 8 + 4 * (i % 2)).bitwiseAND(F.lit(15))
        for i in range(2 * max_bits)
    ]
    return F.transform(_keys(halves, 4, max_bits), lambda k: F.xxhash64(key, k))


class _Lists:
    """Streams (key, fp) sorted by key; yields links in a list, or the members of lists above `most`."""

    def __init__(self, max_bits: int, most: int | None):
        self.max_bits, self.most = max_bits, most

    def __call__(self, batches):
        keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)
        open_key = None  # of a list known to be above `most`
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
            yield from self._done(keys[:last], prints[:last], open_key)
            if self.most is not None and (keys[-1] == open_key or len(keys) - last > self.most):
                open_key = keys[-1]
                yield self._rows(keys[last:], prints[last:])
                keys, prints = keys[:0], prints[:0]
            else:
                keys, prints = keys[last:], prints[last:]
        yield from self._done(keys, prints, open_key)

    def _done(self, keys, prints, open_key):
        if not len(keys):
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        large = np.repeat((keys[starts] == open_key) | (self.most is not None and sizes > (self.most or 0)), sizes)
        if large.any():
            yield self._rows(keys[large], prints[large])
        single = np.repeat(sizes == 1, sizes)
        keys, prints = keys[~large & ~single], prints[~large & ~single]
        at, step, found = np.arange(len(keys)), 0, []
        while len(at):
            step += 1
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            near = np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= self.max_bits
            if near.any():
                found.append((at[near], at[near] + step))
        if found:
            yield self._rows(*self._joining(prints, *map(np.concatenate, zip(*found))), link=True)

    def _joining(self, prints, a, b):
        """Of the links, those that join two parts not joined before."""
        root: dict[int, int] = {}

        def find(x):
            while x in root:
                up = root[x]
                if up in root:
                    root[x] = root[up]
                x = up
            return x

        kept = []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = find(x), find(y)
            if x != y:
                root[y] = x
                kept.append(i)
        return prints[a[kept]], prints[b[kept]]

    @staticmethod
    def _rows(a, b, link=False):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), link))], ["a", "b", "link"])


def _met(keyed: DataFrame, max_bits: int, most: int | None) -> DataFrame:
    """a, b, link of the lists of (key, fp)."""
    lists = _Lists(max_bits, most)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(
        lambda batches: lists(batches), "a bigint, b bigint, link boolean")


def links(prints: DataFrame, max_bits: int = MAX_BITS, most: int = LIST) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join all that are linked."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the index finds links of at most 4 bits")
    first = stored(_met(prints.select(F.explode(_byte_keys(F.col("fp"), max_bits)).alias("key"), "fp"), max_bits, most), "simhash")
    found = first.where("link").select("a", "b")
    if max_bits:  # else equal keys are equal fingerprints
        opened = first.where(~F.col("link")).select(
            F.explode(_half_byte_keys(F.col("a"), F.col("b"), max_bits)).alias("key"), F.col("b").alias("fp"))
        found = found.unionByName(_met(opened, max_bits, None).select("a", "b"))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: id, fp, component_id (the least id reachable over links, null if there is none)."""
    return _classes(fingerprints(docs, id_col, text, n), max_bits).withColumnRenamed("id", id_col)


_PARTS = 32  # of a component


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """id, fp, component_id of id, fp; ids of any type with an order."""
    prints = stored(prints, "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), max_bits))
    # only fingerprints with links need their component's name; the others' is their own least id
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root")).distinct()
    members = distinct.join(linked, "fp").select("fp", "least", "root", F.pmod(F.xxhash64("fp"), F.lit(_PARTS)).alias("part"))
    # a large component meets its name in parts
    named = members.groupBy("root").agg(F.min("least").alias("component_id")).select(
        "root", "component_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_PARTS - 1).cast("bigint"))).alias("part"))
    moved = members.join(named, ["root", "part"]).select(F.col("fp").alias("_fp"), "component_id")
    # written first: then both sides of the join are plain shuffles, and Spark splits the rows of a hot fingerprint
    names = stored(distinct.join(moved, distinct["fp"] == moved["_fp"], "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")), "names")
    return prints.join(names, "fp").select("id", "fp", "component_id")


def simhash_digests(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """One whole row of each component: the least id, then the least text hash; rows without an id only if alone.

    Most rows stay, so only the names of those that go are joined to the
    documents, at every size by a hashed join whose build side they are: the
    documents are shuffled once and no text is sorted, so what the join writes
    follows the documents, and nothing is broadcast that grows with them.
    """
    key = named(id_col).cast("bigint")
    hashed = (F.xxhash64(text_of(f"`{text}`")), F.xxhash64(F.lit(1), text_of(f"`{text}`")))
    name = F.struct(key.isNull().alias("no_id"), F.coalesce(key, F.lit(0).cast("bigint")).alias("id"),
                    hashed[0].alias("h"), hashed[1].alias("h2"))
    found = _classes(_fingerprints(docs.select(name.alias("id"), text_of(f"`{text}`").alias("text")), n), max_bits)
    # two numbers name the rows of one id and text
    names = (F.col("id.h").alias("_a"), F.xxhash64("id.h2", "id.no_id", "id.id").alias("_b"))
    counted = stored(found.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("id") == F.col("component_id")).alias("stays")), "kept")
    out = counted.where("not stays or n > 1").select("_a", "_b")
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("_row"), hashed[0].alias("_a"),
                       F.xxhash64(hashed[1], key.isNull(), F.coalesce(key, F.lit(0).cast("bigint"))).alias("_b"))
    left = rows.join(out.hint("shuffle_hash"), ["_a", "_b"], "left_anti").select("_row.*")
    same = counted.where("stays and n > 1").select("_a", "_b")
    if same.limit(1).count():  # rows of one id and text: the first by what else they hold, found by partial minima
        first = rows.join(same, ["_a", "_b"], "left_semi").groupBy("_a", "_b").agg(
            F.min_by("_row", F.to_json("_row")).alias("_row"))
        left = left.unionByName(first.select("_row.*"))
    return left
