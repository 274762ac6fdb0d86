"""Token ids in Simple-8b words.

A 64-bit word is a selector (high 4 bits) and up to 60 payload bits that hold
as many ids as the selector says, the first in the lowest bits.  Ids are coded
in blocks of BLOCK; a block begins at a word of its own, so blocks decode
alone and all words of one selector decode together.

Layout of a segment (little-endian): magic "NS8B", u32 number of blocks, u64
number of ids, u32 x (blocks + 1) first word of each block, u32 x (blocks + 1)
first escape of each block, u64 words, u64 escaped ids.  An id of more than 60
bits is escaped: its word has selector 0 and the id's place among the block's
escapes as payload.

The segments of a corpus are rows of a Parquet table (Spark writes no other
files of its own choosing): part, seq, first (ids of the part before it),
doc_ids, lengths, n_ids, payload, in ascending (part, seq), documents in
ascending doc_id.

Defined results.  A null text is the empty text: its document holds the end id
alone.  Null ids come first; rows with one id are ordered by text; repeated
rows are documents of their own.  An empty table writes an empty table.  Only
the id and text columns are read.  A segment closes at SEGMENT ids, so only
a single document makes it longer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.llm.common import per_batch, per_task, text_of
from newsloom.llm.pieces import FlatEncoder, text_bytes, worker_kept

#: Fixed values of the coding: ids and bits per word, by selector; selector 0 is an escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_STEPS = COUNTS.astype(np.uint8)
MAGIC = b"NS8B"
BLOCK = 8192
KEPT_CUTS = 300_000  # distinct pieces that a worker keeps, about 15 MB
BATCH_BYTES = 12_000_000  # of texts encoded together
SEGMENT = 1 << 20


_SMALL = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.uint8)  # bits of ids below 2^16


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (at least 1)."""
    if not len(ids) or ids.max() < len(_SMALL):
        return _SMALL[ids]
    bits = np.ones(len(ids), np.uint8)
    for k in range(1, 64):
        over = ids >> np.uint64(k)
        if not over.any():
            break
        bits += over > 0
    return bits


def _selectors(bits: np.ndarray) -> np.ndarray:
    """At each place, the selector that takes the most of the ids from there on."""
    fits, widest, reach = np.zeros(len(bits), np.uint8), bits, 1  # widest id among the next `reach`
    for selector in range(len(COUNTS) - 1, 0, -1):
        more = COUNTS[selector] - reach  # never over `reach`
        if more >= len(widest):
            break
        if more:
            widest, reach = np.maximum(widest[:-more], widest[more:]), COUNTS[selector]
        # where a selector fits, so do those of fewer and wider ids
        fits[:len(widest)] += widest <= BITS[selector]
    return np.where(fits, len(COUNTS) - fits, 0).astype(np.uint8)


def pack(ids: Sequence[int] | np.ndarray) -> bytes:
    """A segment of the ids."""
    ids = np.asarray(ids, np.uint64)
    blocks = np.arange(0, len(ids) + BLOCK, BLOCK) if len(ids) else np.zeros(1, np.int64)
    selectors = [_selectors(_bits(ids[k:k + BLOCK])) for k in blocks[:-1]]
    selectors = np.concatenate([*selectors, np.zeros(0, np.uint8)])
    # no word reaches over the end of its block
    at, step, n, begins = 0, _STEPS[selectors].tobytes(), len(ids), bytearray(len(ids))
    while at < n:
        begins[at] = 1
        at += step[at]
    starts = np.flatnonzero(np.frombuffer(begins, np.uint8))
    chosen, word_at = selectors[starts], np.searchsorted(starts, blocks)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.flatnonzero(np.bincount(chosen, minlength=1)):
        which = np.flatnonzero(chosen == s)
        if s == 0:
            before = np.searchsorted(which, word_at)
            words[which] |= (np.arange(len(which)) - np.repeat(before[:-1], np.diff(before))).astype(np.uint64)
            continue
        first, packed = starts[which], np.zeros(len(which), np.uint64)
        for k in range(COUNTS[s]):
            packed |= ids[first + k] << np.uint64(k * BITS[s])
        words[which] |= packed
    escapes = starts[chosen == 0]
    head = MAGIC + np.uint32(len(blocks) - 1).tobytes() + np.uint64(len(ids)).tobytes()
    tables = [x.astype("<u4").tobytes() for x in (word_at, np.searchsorted(escapes, blocks))]
    return b"".join([head, *tables, words.astype("<u8").tobytes(), ids[escapes].astype("<u8").tobytes()])


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks first to last (exclusive) of a segment; all by default."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    blocks, total = int(np.frombuffer(payload, "<u4", 1, 4)[0]), int(np.frombuffer(payload, "<u8", 1, 8)[0])
    first, last = min(first, blocks), blocks if last is None else min(last, blocks)
    word_at = np.frombuffer(payload, "<u4", blocks + 1, 16).astype(np.int64)
    escape_at = np.frombuffer(payload, "<u4", blocks + 1, 20 + 4 * blocks).astype(np.int64)
    words_from = 24 + 8 * blocks
    words = np.frombuffer(payload, "<u8", int(word_at[-1]), words_from)[word_at[first]:word_at[last]]
    escapes = np.frombuffer(payload, "<u8", int(escape_at[-1]), words_from + 8 * int(word_at[-1]))
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    place = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    payloads = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selectors):
        which = np.flatnonzero(selectors == s)
        if s == 0:
            block = np.searchsorted(word_at, which + word_at[first], side="right") - 1
            out[place[which]] = escapes[escape_at[block] + payloads[which].astype(np.int64)]
            continue
        shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
        mask = np.uint64((1 << int(BITS[s])) - 1)
        out[place[which][:, None] + np.arange(COUNTS[s])] = (payloads[which][:, None] >> shifts) & mask
    if (first, last) == (0, blocks) and len(out) != total:
        raise ValueError("a segment of token ids is damaged")
    return out


_SEPARATOR = "\t"
_JOINED = 4096  # parts in one text for the library
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Where a match of the ByteLevel split surely ends: behind a letter before an ASCII character that is none,
#: behind a single line end before a letter, and behind a sign before a line end.
_SAFE = re.compile(rf"(?<=[{_LETTER}])(?=[\x00-@\[-`{{-\x7f])|(?<=\S\n)(?=[{_LETTER}])|(?<=[!-/:-@\[-`{{-~])(?=\n)")


def _byte_signs() -> list[str]:
    """The character by which a ByteLevel tokenizer writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)).difference(shown))
    return [chr(b) if b in shown else chr(256 + others.index(b)) for b in range(256)]


def _matches(tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None:
    """The tokenizer's model on pieces that are one match of the ByteLevel split each; None if it may leave bytes out.

    The tokens of a match are its bytes, so the ids of many matches are told
    apart by the lengths of their tokens.
    """
    from tokenizers import Tokenizer

    model, vocabulary, signs = tokenizer.model, tokenizer.get_vocab(with_added_tokens=False), _byte_signs()
    if type(model).__name__ != "BPE" or not vocabulary.keys() >= set(signs) or (
            model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix):
        return None
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, k in vocabulary.items():
        lengths[k] = len(token)
    alone, written = Tokenizer(model), dict(enumerate(signs))

    def matches(pieces):
        raw = _SEPARATOR.join(pieces).encode().decode("latin-1").translate(written).split(signs[ord(_SEPARATOR)])
        groups = [raw[k:k + _JOINED] for k in range(0, len(raw), _JOINED)]
        coded = alone.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in coded])
        done = np.cumsum(lengths[ids])
        ends = np.searchsorted(done, np.cumsum([*map(len, raw)])) + 1
        if len(raw) != len(pieces) or ends[-1] != len(ids):
            raise ValueError("the tokens of a match are not its bytes")
        return ids, np.diff(ends, prepend=0)

    return matches


def _library(path: str) -> FlatEncoder:
    """The tokenizers library behind the pieces.

    Pieces that are surely one match of the ByteLevel split go to the library's
    model, many at once.  The others are split by the library: it never merges
    across the places of _SAFE, so the parts between them are asked for once,
    and a tab behind a part, before a space or none, is a match of its own: parts
    without tabs, and without white space around them but one space before, are
    encoded as one text with tabs between them.  What is left, and the cuts of
    any other tokenizer, go one by one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core

    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        step = str(tokenizer.pre_tokenizer)
        plain = step.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in step and tokenizer.normalizer is None

        def whole(texts):
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        separator = np.frombuffer(whole([_SEPARATOR])[0], "<u4")

        def library(parts):
            out = [b""] * len(parts)
            joined = [k for k, c in enumerate(parts) if _SEPARATOR not in c and c and not c[-1].isspace()
                      and not c[0 if c[0] != " " else 1].isspace()] if len(separator) == 1 else []
            alone = sorted(set(range(len(parts))).difference(joined))
            for k, ids in zip(alone, whole([parts[k] for k in alone])):
                out[k] = ids
            groups = [joined[k:k + _JOINED] for k in range(0, len(joined), _JOINED)]
            for group, raw in zip(groups, whole([_SEPARATOR.join(parts[k] for k in g) for g in groups])):
                between = np.flatnonzero(np.frombuffer(raw, "<u4") == separator[0])
                begins, ends = [0, *(4 * between + 4).tolist()], [*(4 * between).tolist(), len(raw)]
                for k, a, b in zip(group, begins, ends):
                    out[k] = raw[a:b]
            return out

        def by_part(cuts):
            # a space and letters behind it hold no such place
            several = {k: _SAFE.split(c) for k, c in enumerate(cuts) if not (c[1:].isalpha() and c[0] == " ")}
            several = {k: parts for k, parts in several.items() if len(parts) > 1}
            more = list(set(chain.from_iterable(several.values())))
            made = library([c for k, c in enumerate(cuts) if k not in several] + more)
            ids, others = dict(zip(more, made[len(cuts) - len(several):])), iter(made)
            return [b"".join(map(ids.__getitem__, several[k])) if k in several else next(others) for k in range(len(cuts))]

        return FlatEncoder(by_part if plain else whole, KEPT_CUTS, _matches(tokenizer) if plain else None)

    return worker_kept(f"tokenizers:{path}", make)


_SEGMENTS = "part int, seq int, first bigint, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, payload binary"


def write_ids(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encodes whole texts, end id behind each, and writes them as segments in ascending id."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    placed = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def grouped(first: np.ndarray):
        """Ranges of texts that are encoded together."""
        a = 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(first, first[a] + BATCH_BYTES, side="right")) - 1)
            yield a, b
            a = b

    @per_task
    def work():
        encoder, part, seq, first = _library(path), TaskContext.get().partitionId(), 0, 0

        def step(batch):
            nonlocal seq, first
            made, tops, sizes = {c: [] for c in ("part", "seq", "first", "n_ids", "payload")}, [0], [np.zeros(0, np.int64)]
            for a, b in grouped(text_bytes(batch["text"])[1]):
                ids, lengths = encoder(batch["text"].slice(a, b - a), end_id)
                ends = np.cumsum(lengths)
                k = at = 0
                while k < len(ends):  # a segment ends with the document that fills it
                    last = min(int(np.searchsorted(ends, at + SEGMENT)), len(ends) - 1)
                    n = int(ends[last]) - at
                    for c, v in zip(made.values(), (part, seq, first, n, pack(ids[at:at + n]))):
                        c.append(v)
                    tops.append(a + last + 1)
                    k, at, seq, first = last + 1, at + n, seq + 1, first + n
                sizes.append(lengths)
            listed = lambda values: pa.ListArray.from_arrays(pa.array(tops, pa.int32()), values)
            return made | {"doc_ids": listed(batch["doc_id"]), "lengths": listed(pa.array(np.concatenate(sizes), pa.int64()))}

        return step

    per_batch(placed, work, _SEGMENTS, arrays=True).write.parquet(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    # one row per writing task: its window is over a few numbers, and it is broadcast
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    placed = segments.join(F.broadcast(offsets), "part").select(
        "doc_ids", "lengths", (F.col("part_start") + F.col("first")).alias("start"), "payload")

    def work(batch):
        lengths, docs = batch["lengths"].flatten().to_numpy(), np.diff(batch["lengths"].offsets.to_numpy())
        ids = [unpack(payload).astype("<u4") for payload in batch["payload"].to_pylist()]
        ends = np.cumsum(lengths)
        # documents lie one behind the other in a segment, segments in a batch
        before = np.cumsum([0, *map(len, ids)])[:-1]
        begin = ends - lengths + np.repeat(batch["start"].to_numpy() - before, docs)
        raw, bounds = np.concatenate([*ids, np.zeros(0, "<u4")]), np.concatenate([[0], 4 * ends])
        if bounds[-1] != 4 * len(raw):
            raise ValueError("segments do not hold the ids of their documents")
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(raw)]
        return {"doc_id": batch["doc_ids"].flatten(), "start": begin, "n_tokens": lengths,
                "ids": pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers)}

    return per_batch(placed, work, "doc_id bigint, start bigint, n_tokens bigint, ids binary", arrays=True)


def id_digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read back."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
