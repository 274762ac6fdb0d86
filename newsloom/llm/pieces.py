"""Texts cut where byte-level BPE never merges across, so that each distinct cut is encoded once.

A single space before a character that is no white space always begins a new
match of the split pattern: a text is the concatenation of such cuts, and its
ids are the concatenation of theirs.  Cuts are therefore encoded once per
worker and looked up afterwards.  What a worker keeps is bounded; a cut that
does not fit is encoded again in the next batch.  For the ByteLevel split the
other places where a match surely begins are told by the bytes around them, so
that a text falls into words and signs, of which there are far fewer kinds.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")  # \S is narrower here than in the split pattern, so every cut is a safe one
KEPT_CUTS = 300_000  # about 70 MB
KEPT_LENGTH = 64
BATCH_CHARS = 2_000_000


def worker_kept(key: str, make: Callable[[], object]):
    """An object that the worker process keeps between tasks."""
    holder = sys.modules.setdefault("_newsloom_worker", types.ModuleType("_newsloom_worker"))
    if not hasattr(holder, key):
        setattr(holder, key, make())
    return getattr(holder, key)


def cuts(text: str) -> list[str]:
    """The cuts of a text; all but the first lack the space before them."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class CutEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids by way of their distinct cuts."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], kept_cuts: int = KEPT_CUTS):
        self.encode, self.kept_cuts = encode, kept_cuts
        self.kept: dict[str, bytes] = {}

    def _batch(self, texts: Sequence[str]) -> list[bytes]:
        parts = [cuts(t) for t in texts]
        firsts = [p.pop(0) for p in parts]
        wanted, kept = set().union(*parts), self.kept
        new = [c for c in wanted if c not in kept]
        made = list(self.encode([" " + c for c in new] + firsts))
        ids = {c: kept[c] for c in wanted if c in kept}
        ids.update(zip(new, made))
        for cut in new[:max(0, self.kept_cuts - len(kept))]:
            if len(cut) <= KEPT_LENGTH:
                kept[cut] = ids[cut]
        return [first + b"".join(map(ids.__getitem__, p)) for first, p in zip(made[len(new):], parts)]

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        out, batch, chars = [], [], 0
        for text in texts:
            if batch and chars + len(text) > BATCH_CHARS:
                out += self._batch(batch)
                batch, chars = [], 0
            batch.append(text)
            chars += len(text)
        return out + (self._batch(batch) if batch else [])


#: What a byte of UTF-8 is to the ByteLevel split.  UNSURE may be white space or not; OTHER is none, yet may be a letter.
UNSURE, SPACE, BLANK, LETTER, DIGIT, SIGN, APOSTROPHE, OTHER = range(8)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[:128] = SIGN
    kind[28:32] = UNSURE
    kind[32], kind[9:14], kind[39] = SPACE, BLANK, APOSTROPHE
    for first, last, what in (("0", "9", DIGIT), ("A", "Z", LETTER), ("a", "z", LETTER)):
        kind[ord(first):ord(last) + 1] = what
    return kind


_KIND = _kinds()
_SORT = np.array([7, 7, 7, 1, 2, 4, 4, 7], np.uint8)  # of each kind, as bits: letter, digit, sign; all where it is not sure


def _kinds_of(signs: np.ndarray) -> np.ndarray:
    """The kind of each byte; Latin and Cyrillic letters of two bytes are letters, blocks that hold white space unsure."""
    kind = _KIND[signs]
    far = np.flatnonzero(signs >= 0xC2)  # first bytes of characters of several
    if len(far):
        lead, second = signs[far], signs[far + 1]
        letter = ((lead >= 0xC3) & (lead <= 0xC8) & ((lead > 0xC3) | (second & 0xDF != 0x97))) | (lead == 0xD0) | (lead == 0xD1)
        kind[far[letter]] = kind[far[letter] + 1] = LETTER
        unsure = ((lead == 0xE1) & ((second == 0x9A) | (second == 0xA0))) | ((lead == 0xE2) & (second & 0xFE == 0x80)) | (
            (lead == 0xE3) & (second == 0x80))
        kind[far[lead == 0xC2]] = kind[far[lead == 0xC2] + 1] = UNSURE
        for k in range(3):
            kind[far[unsure] + k] = UNSURE
    return kind


def _starts(signs: np.ndarray, first: np.ndarray, signs_too: bool) -> np.ndarray:
    """Where the pieces of texts begin; first: where the texts do, and their end.

    A space before a character that is no white space begins a match of the
    split pattern.  With signs_too so do all white space behind or before such a
    character, what follows white space other than a space, and a letter, digit
    or sign behind one of another sort, but for a letter behind an apostrophe.
    """
    if not len(signs):
        return np.zeros(0, np.int64)
    kind = _kinds_of(signs)
    solid, cut, after = kind >= LETTER, np.zeros(len(signs), bool), np.zeros(len(signs), bool)
    after[:-1] = solid[1:]
    after[first[1:] - 1] = False  # the next text is none of this one
    if signs_too:
        blank = (kind == SPACE) | (kind == BLANK)
        np.logical_and(kind[:-1] == BLANK, solid[1:], out=cut[1:])
        cut[1:] |= solid[:-1] & blank[1:]
        cut |= after & blank
        sort = _SORT[kind]
        cut[1:] |= (sort[:-1] & sort[1:] == 0) & ((kind[:-1] != APOSTROPHE) | (kind[1:] != LETTER))
    else:
        cut |= after & (kind == SPACE)
    cut[first[:-1][np.diff(first) > 0]] = True
    return np.flatnonzero(cut)


def _single(pieces: pa.Array) -> np.ndarray:
    """Which pieces are surely one match: a space or none, then letters, digits or signs without an apostrophe."""
    signs, first = text_bytes(pieces)
    kind = _kinds_of(signs)
    other = (kind < LETTER) | (kind > SIGN)
    opening = first[:-1]
    other[opening] &= (kind[opening] != SPACE) | (np.diff(first) == 1)
    return np.add.reduceat(other, opening, dtype=np.int64) == 0 if len(pieces) else np.zeros(0, bool)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of texts, and where each text begins, and the end."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    first = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first[0]:first[-1]], first - first[0]


class FlatEncoder:
    """Encodes texts to one array of ids: the pieces of a batch are numbered in Arrow, and only new ones become strings.

    `single` encodes pieces that are one match of a ByteLevel split, as (all ids, how many each has); with it texts are
    also cut at line ends and signs.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], kept_cuts: int = KEPT_CUTS,
                 single: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.encode, self.kept_cuts, self.single = encode, kept_cuts, single
        self.kept = pa.array([], pa.binary())
        # of the kept pieces: their ids, where those of each begin and how many they are
        self.ids, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of new pieces, where those of each begin and how many they are."""
        size, start = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        texts, ids = new.cast(pa.string()), []
        single = _single(new) if self.single else np.zeros(len(new), bool)
        for which in (single, ~single):
            some = texts.filter(pa.array(which)).to_pylist()
            if not some:
                continue
            if which is single:
                flat, sizes = self.single(some)
            else:
                coded = list(self.encode(some))
                flat, sizes = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            size[which], start[which] = sizes, sum(map(len, ids)) + np.cumsum(sizes) - sizes
            ids.append(flat)
        return np.concatenate([*ids, np.zeros(0, "<u4")]), start, size

    def __call__(self, texts: Sequence[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and the number of ids of each."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        signs, first = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        starts = _starts(signs, first, self.single is not None)
        bounds = pa.py_buffer(np.append(starts, len(signs)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(signs)])
        # the kept pieces come first in the dictionary, so their numbers stay
        coded = pa.chunked_array([self.kept, pieces]).dictionary_encode().combine_chunks()
        codes, new = coded.indices.to_numpy()[len(self.kept):], coded.dictionary[len(self.kept):]
        new_ids, new_start, new_size = self._encoded(new)
        ids = np.concatenate([self.ids, new_ids, np.array([end_id], "<u4")])
        # the end of a text is one more piece
        start = np.concatenate([self.start, new_start + len(self.ids), [len(ids) - 1]]).astype(np.int32)
        size = np.concatenate([self.size, new_size, [1]]).astype(np.int32)
        behind = np.searchsorted(starts, first[1:])
        codes = np.insert(codes, behind, len(start) - 1)
        sizes = size[codes]
        done = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(start[codes] - (done - sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        out = ids[at]
        self._keep(new, new_ids, new_start, new_size)
        return out, np.diff(done[behind + np.arange(len(behind))], prepend=0)

    def _keep(self, new: pa.Array, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        which = np.flatnonzero(pc.binary_length(new).to_numpy() <= KEPT_LENGTH)[:max(0, self.kept_cuts - len(self.kept))]
        if len(which):
            start, size = start[which], size[which]
            behind = np.cumsum(size)
            at = np.repeat(start - (behind - size), size) + np.arange(int(behind[-1]))
            self.start = np.concatenate([self.start, len(self.ids) + behind - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids[at]])
            self.kept = pa.concat_arrays([self.kept, new.take(pa.array(which))])
