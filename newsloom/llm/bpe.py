"""Byte-level BPE encoding and decoding by ranks.

The bytes of a piece lie in the leaves of a segment tree.  A leaf holds the
rank of the pair that starts there, with its position behind it, and every
node the least below it, so the root names the leftmost pair of minimum rank.
A merge changes the leaves of the merged pair, of its right part and of its
left neighbour, and climbs from these three: a logarithmic number of updates.
Pieces whose trees have one size are merged side by side in arrays, one step
for all of them at a time.

Defined results.  A null text is the empty text and has no ids.  Rows are
encoded alone: repeated rows give equal rows, empty tables empty ones, null
ids stay.  Only the id and text columns are read.  Pieces may be of any
length; n bytes take O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import per_batch, per_task, text_of
from newsloom.llm.pieces import CutEncoder, worker_kept

_NONE = np.int64(1) << 62
_LOW = np.int64((1 << 32) - 1)
_CELLS = 1 << 18  # leaves in one round of side-by-side merging


class Ranks:
    """A rank file: base64 of the token's bytes, a space, its rank, on each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ids.items()}
        # the library's \s is Unicode white space
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        get = self.ids.get
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def _merge(self, pieces: Sequence[bytes], leaves: int) -> list[np.ndarray]:
        """Ids of pieces of at most `leaves` bytes (a power of two), all at once."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        ids = self.byte_ids[raw]
        places = np.arange(leaves)
        inside = places < sizes[:, None]
        tree = np.full((n, 2 * leaves), _NONE)
        first = self.rank(ids[:, :-1], ids[:, 1:])
        first = np.where(inside[:, 1:] & (first < _NONE), first << 32 | places[:-1], _NONE)
        tree[:, leaves:2 * leaves - 1] = first
        width = leaves
        while width > 1:
            width //= 2
            tree[:, width:2 * width] = np.minimum(tree[:, 2 * width:4 * width:2], tree[:, 2 * width + 1:4 * width:2])
        right = np.broadcast_to(places + 1, (n, leaves)).copy()  # next live leaf; `sizes` is the end
        left = np.broadcast_to(places - 1, (n, leaves)).copy()
        live = inside
        flat_tree, flat_ids, flat_right, flat_left, flat_live = (x.reshape(-1) for x in (tree, ids, right, left, live))
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            base, at, new = rows * leaves, best & _LOW, best >> 32
            gone = flat_right[base + at]
            after = flat_right[base + gone]
            before = flat_left[base + at]
            flat_ids[base + at] = new
            flat_live[base + gone] = False
            flat_right[base + at] = after
            more = after < sizes[rows]
            flat_left[(base + after)[more]] = at[more]
            has = before >= 0
            ahead = np.where(more, self.rank(new, flat_ids[base + np.where(more, after, at)]), _NONE)
            behind = self.rank(flat_ids[(base + before)[has]], new[has])
            at_tree = rows * (2 * leaves) + leaves
            node = np.concatenate([at_tree + gone, at_tree + at, (at_tree + before)[has]])
            flat_tree[node] = np.concatenate([
                np.full(len(rows), _NONE),
                np.where(ahead < _NONE, ahead << 32 | at, _NONE),
                np.where(behind < _NONE, behind << 32 | before[has], _NONE),
            ])
            start = np.concatenate([rows, rows, rows[has]]) * (2 * leaves)
            node -= start
            while node[0] > 1:  # all are on one level
                node >>= 1
                child = start + 2 * node
                flat_tree[start + node] = np.minimum(flat_tree[child], flat_tree[child + 1])
            rows = rows[tree[rows, 1] < _NONE]
        return [ids[i][live[i]] for i in range(n)] if leaves > 64 else np.split(
            ids[live], np.cumsum(live.sum(axis=1))[:-1])

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers; a piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for leaves, which in by_size.items():
            step = max(1, _CELLS // leaves)
            for k in range(0, len(which), step):
                some = which[k:k + step]
                for i, ids in zip(some, self._merge([pieces[j] for j in some], leaves)):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """Ids of each cut; each distinct match of the pattern is merged once."""
        split = [self.split(c) for c in cuts]
        distinct = list(set().union(*split)) if split else []
        ids = dict(zip(distinct, self.encode_pieces([p.encode("utf-8", "replace") for p in distinct])))
        return [ids[s[0]] if len(s) == 1 else b"".join(map(ids.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids (little-endian unsigned 32-bit) stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(path: str, pattern: str) -> tuple[Ranks, CutEncoder]:
    def make():
        ranks = Ranks(path, pattern)
        return ranks, CutEncoder(ranks.encode_cuts)

    return worker_kept(f"bpe:{path}:{pattern}", make)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ids (binary, little-endian unsigned 32-bit).  `path` is a file on every machine."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text"))

    @per_task
    def work():
        _, encoder = _encoder(path, pattern)
        return lambda batch: {"ids": encoder(batch["text"])}

    schema = f"id {texts.schema['id'].dataType.simpleString()}, ids binary"
    return per_batch(texts, work, schema, reads=["text"]).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, bytes (binary) that the ids stand for."""
    rows = encoded.select(F.col(id_col).alias("id"), "ids")

    @per_task
    def work():
        ranks, _ = _encoder(path, pattern)
        return lambda batch: {"bytes": [ranks.decode(i or b"") for i in batch["ids"]]}

    schema = f"id {rows.schema['id'].dataType.simpleString()}, bytes binary"
    return per_batch(rows, work, schema, reads=["ids"]).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text",
            with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, digests of its ids and of what they decode to, and the ids if asked for."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    @per_task
    def work():
        ranks, encoder = _encoder(path, pattern)

        def step(batch):
            ids = encoder(batch["text"])
            return {"n_tokens": [len(i) // 4 for i in ids], "ids_sha256": list(map(sha, ids)),
                    "decoded_sha256": [sha(ranks.decode(i)) for i in ids], **({"ids": ids} if with_ids else {})}

        return step

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return per_batch(texts, work, schema, reads=["text"])
