"""SentencePiece BPE with offsets: every piece is projected to the bytes of the source that it covers.

Normalisation walks a text by the longest prefix that the model's compiled
character map (a double-array trie in the model file) knows, else by one
character, and records for every normalised character the source byte at which
it began (`Normaliser`).  Pieces are then merged on the normalised characters,
best score first, then leftmost, and a character that no piece holds falls
back to its bytes.  A piece's span runs from the source byte of its first
normalised character to that of the next piece; of the bytes of one fallen
character the last has the character's span, the others are empty there.

No piece crosses two characters that stand side by side in no piece, so pieces
are merged between such places.  A space behind another character is always
one in a vocabulary without pieces that hold a space behind something else.
If also the map keeps spaces as they are, texts are cut there before they are
normalised, and each distinct cut is encoded once and looked up afterwards;
what a worker keeps is bounded.  Else a text is normalised whole.

Defined results.  A null text is the empty text and has no ids.  Rows are
encoded alone: repeated rows give equal rows, empty tables empty ones, null
ids stay.  Only the id and text columns are read.  Texts may be of any length;
n characters without a space take O(n log n).  A model that is not BPE with
byte fallback, or has pieces of the kinds user-defined or unused, or white
space behind words, or rules for the decoded text, is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import sub

import numpy as np
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import per_batch, per_task, text_of
from newsloom.llm.pieces import KEPT_LENGTH, worker_kept

SPACE = "▁"  # how pieces show a space
BATCH_CHARS = 4_000_000  # of texts encoded together
KEPT_CUTS = 500_000  # distinct cuts that a worker keeps, about 150 MB
#: Fixed values of the model format: kinds of pieces, and the number of the BPE algorithm.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE, _BPE = 1, 2, 3, 6, 2
_SHORT, _TOGETHER, _NEVER = 48, 20_000, np.int64(1) << 40
_ONE_BY_ONE = "newsloom.one-by-one"
codecs.register_error(_ONE_BY_ONE, lambda e: ("�", e.start + 1))


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, message[at:at + size]
        at += size


class CharMap:
    """A compiled character map: u32 size of the trie, the trie's 32-bit units, replacements that end in a null byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.replacements = compiled[4 + size:]

    def longest(self, raw: bytes, at: int) -> tuple[int, int]:
        """Bytes of the longest known prefix of raw[at:] and where its replacement begins; 0, 0 if there is none."""
        if not self.units:
            return 0, 0
        best, node = (0, 0), self._child(self.units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != raw[k]:  # the label of an inner unit
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:  # a key ends here, its value lies in the first child
                best = k + 1 - at, self.units[node] & 0x7FFFFFFF
        return best

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def replacement(self, begin: int) -> str:
        return self.replacements[begin:self.replacements.index(b"\0", begin)].decode()


class Normaliser:
    """What a model does to a text before it looks for pieces."""

    def __init__(self, rules: dict):
        self.map = CharMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.show = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.keeps = self.show and not self.squeeze and not self.map.units  # each character stays as it is

    def __call__(self, text: str, prefix: bool) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters, and its end, the source byte."""
        raw, out, begins, at, after_space = text.encode("utf-8", "replace"), [], [], 0, self.squeeze
        if not raw:
            return "", [0]
        if self.keeps:
            begins = range(len(raw) + 1)
            if len(raw) > len(text):
                begins = np.flatnonzero((np.frombuffer(raw + b"a", np.uint8) & 0xC0) != 0x80).tolist()
            shown = text.replace(" ", SPACE)
            return (SPACE + shown, [0, *begins]) if prefix and self.prefix else (shown, begins)
        while at < len(raw):
            size, where = self.map.longest(raw, at)
            if size:
                new = self.map.replacement(where)
            else:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at:at + size].decode()
            for c in new.lstrip(" ") if after_space else new:
                out.append(c)
                begins.append(at)
            if self.squeeze and new:
                after_space = new.endswith(" ") if not after_space or new.strip(" ") else True
            at += size
        end = at
        while self.squeeze and out and out[-1] == " ":
            out.pop()
            end = begins.pop()
        if prefix and self.prefix and (out or not self.squeeze):
            out.insert(0, " ")
            begins.insert(0, begins[0] if begins else 0)
        joined = "".join(out)
        return joined.replace(" ", SPACE) if self.show else joined, [*begins, end]


class _Kept(dict):
    """Cuts that a worker keeps; those of the present batch alone are in `others`."""

    others: dict[str, tuple[bytes, bytes]] = {}

    def __missing__(self, cut: str) -> tuple[bytes, bytes]:
        return self.others[cut]


class PieceModel:
    """A SentencePiece BPE model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        trainer, rules, back = ({k: v for n, m in model if n == number for k, v in _fields(m)} for number in (2, 3, 5))
        kinds = [p.get(3, _NORMAL) for p in pieces]
        if (trainer.get(3, 1) != _BPE or not trainer.get(35) or trainer.get(24) or back.get(2)
                or not set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces")
        names = [p[1].decode() for p in pieces]
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == _NORMAL}
        self.order = {name: -struct.unpack("<f", pieces[i].get(2, b"\0\0\0\0"))[0] for name, i in self.ids.items()}
        self.bytes = {int(name[1:-1], 16): i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == _BYTE}
        unknown = trainer.get(44, " ⁇ ".encode())
        self.surfaces = [
            name.replace(SPACE, " ").encode() if kind == _NORMAL else unknown if kind == _UNKNOWN
            else b"" if kind == _CONTROL else bytes([int(name[1:-1], 16)])
            for name, kind in zip(names, kinds)]
        self.leads = [kind == _NORMAL and name.startswith(SPACE) for name, kind in zip(names, kinds)]
        self.normalise = Normaliser(rules)
        self.inside = {name[k:k + 2] for name in self.ids for k in range(len(name) - 1)}
        mixed = any(SPACE in name.lstrip(SPACE) for name in self.ids)  # a space behind something else
        self.cuts = None if mixed or not self.normalise.keeps else self._cutter()
        self.kept = _Kept()
        #: Symbols of the merging: the pieces, then characters that only stand inside pieces or in none.
        self.symbols = dict(self.ids)
        for c in sorted({c for name in self.ids for c in name}):
            self.symbols.setdefault(c, len(names) + len(self.symbols))
        pairs = {}
        costs = {cost: rank for rank, cost in enumerate(sorted(set(self.order.values())))}
        for name, i in self.ids.items():
            for k in range(1, len(name)):
                left, right = self.symbols.get(name[:k]), self.symbols.get(name[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = costs[self.order[name]], i
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank, self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64).T.copy()
        self.lengths = np.array([len(name) for name in names])

    def _split(self, chars: str) -> Iterator[str]:
        """The longest parts of normalised characters whose neighbours all stand side by side in some piece."""
        at, inside = 0, self.inside
        for k in range(1, len(chars)):
            if chars[k - 1:k + 1] not in inside:
                yield chars[at:k]
                at = k
        if at < len(chars):
            yield chars[at:]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (_NEVER: no piece), and the piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER), self.merged[at]

    def _merged_short(self, runs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers and symbols of runs: the best pair of every run is merged at once, the leftmost of equals."""
        width = max(map(len, runs))
        get, none = self.symbols.get, len(self.lengths) + len(self.symbols)  # `none` pairs with nothing
        symbols = np.array([[get(c, none + 1 + ord(c)) for c in r] + [none] * (width - len(r)) for r in runs], np.int64)
        which = np.arange(len(runs))
        ranks, pieces = self._pair(symbols[:, :-1], symbols[:, 1:])
        while len(which):
            if not ranks.shape[1]:
                yield which, symbols
                return
            best = ranks.argmin(axis=1)
            rows = np.arange(len(which))
            going = ranks[rows, best] < _NEVER
            if not going.all():
                yield which[~going], symbols[~going]
                which, symbols, ranks, pieces, best = which[going], symbols[going], ranks[going], pieces[going], best[going]
                rows = np.arange(len(which))
                if not len(which):
                    return
            n, columns = symbols.shape
            symbols[rows, best] = pieces[rows, best]
            keep = np.ones((n, columns), bool)
            keep[rows, best + 1] = False
            symbols = symbols[keep].reshape(n, columns - 1)
            # the merged pair goes; the pairs on both sides of it are new
            ranks, pieces = (x[keep[:, 1:]].reshape(n, columns - 2) for x in (ranks, pieces))
            for side in (best - 1, best):
                some = np.flatnonzero((side >= 0) & (side < columns - 2))
                at = side[some]
                ranks[some, at], pieces[some, at] = self._pair(symbols[some, at], symbols[some, at + 1])

    def _merged(self, runs: list[str]) -> dict[str, tuple[list[int], list[int]]]:
        """Of each run its ids, and the number of characters that each covers."""
        out, by_width = {}, {}
        for run in runs:
            if len(run) > _SHORT:
                parts = self._merged_long(run)
                out[run] = self._named([self.symbols.get(x, -1) for x in parts], run, list(map(len, parts)))
            else:
                by_width.setdefault(-(-len(run) // 4), []).append(run)
        pieces, lengths = len(self.lengths), self.lengths
        none = pieces + len(self.symbols)
        for same in by_width.values():
            for k in range(0, len(same), _TOGETHER):
                some = same[k:k + _TOGETHER]
                for numbers, symbols in self._merged_short(some):
                    inside = symbols != none
                    flat, ends = symbols[inside], np.cumsum(inside.sum(axis=1)).tolist()
                    odd = np.flatnonzero(((symbols >= pieces) & inside).any(axis=1)).tolist()
                    sizes = lengths[np.where(flat < pieces, flat, 0)].tolist() if odd else lengths[flat].tolist()
                    flat, begins = flat.tolist(), [0, *ends]
                    own = [some[n] for n in numbers.tolist()]
                    out.update((run, (flat[a:b], sizes[a:b])) for run, a, b in zip(own, begins, ends))
                    for n in odd:
                        a, b = begins[n], ends[n]
                        out[own[n]] = self._named(flat[a:b], own[n], [
                            z if x < pieces else 1 for x, z in zip(flat[a:b], sizes[a:b])])
        return out

    def _named(self, symbols: list[int], run: str, sizes: list[int]) -> tuple[list[int], list[int]]:
        """Ids and sizes of symbols; a character that is no piece falls back to its bytes, the last of which covers it."""
        ids, covers, at = [], [], 0
        for symbol, size in zip(symbols, sizes):
            if 0 <= symbol < len(self.lengths):
                ids.append(symbol)
            else:
                fallen = run[at:at + size].encode()
                ids += [self.bytes[b] for b in fallen]
                covers += [0] * (len(fallen) - 1)
            covers.append(size)
            at += size
        return ids, covers

    def _merged_long(self, chars: str) -> list[str]:
        parts: list[str] = list(chars)
        n, order = len(parts), self.order
        ahead, back, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            cost = order.get(parts[i] + parts[i + 1])
            if cost is not None:
                heap.append((cost, i, i + 1, len(parts[i]) + len(parts[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or ahead[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged meanwhile
            parts[i] += parts[j]
            parts[j] = ""
            k = ahead[i] = ahead[j]
            if k < n:
                back[k] = i
                cost = order.get(parts[i] + parts[k])
                if cost is not None:
                    heapq.heappush(heap, (cost, i, k, size + len(parts[k])))
            h = back[i]
            if h >= 0:
                cost = order.get(parts[h] + parts[i])
                if cost is not None:
                    heapq.heappush(heap, (cost, h, i, len(parts[h]) + size))
        return [p for p in parts if p]

    def _pieces(self, texts: list[str], prefix: bool) -> Iterator[tuple[bytes, bytes]]:
        """Of each text or cut its ids, and how many source bytes each covers (unsigned 32-bit integers)."""
        normal = [self.normalise(t, prefix) for t in texts]
        runs = [[chars] if self.cuts and len(chars) <= _SHORT else list(self._split(chars)) for chars, _ in normal]
        merged = self._merged(list(set(chain.from_iterable(runs)) - {""}))
        for (_, begins), own in zip(normal, runs):
            ids, covers = merged[own[0]] if len(own) == 1 and own[0] else ([], [])
            if len(own) > 1:
                ids = list(chain.from_iterable(merged[r][0] for r in own))
                covers = list(chain.from_iterable(merged[r][1] for r in own))
            if not isinstance(begins, range):  # else each character is one byte
                ends = [begins[k] for k in accumulate(covers, initial=0)]
                ends[0] = 0  # characters that go before the first piece are its own
                covers = map(sub, ends[1:], ends)
            yield array("I", ids).tobytes(), array("I", covers).tobytes()

    def _cutter(self):
        """Cuts a text: spaces and what follows them, up to a character that stands beside the last in no piece.

        Characters are sorted into classes so that pieces never mix two classes
        (but for the space before a piece); a cut holds one class.
        """
        up: dict[str, str] = {}

        def find(c: str) -> str:
            while up.setdefault(c, c) != c:
                up[c] = c = up[up[c]]
            return c

        for a, b in self.inside:
            if a != SPACE:
                up[find(a)] = find(b)
        classes: dict[str, str] = {}
        for c in sorted(up):
            if c != SPACE:
                classes[find(c)] = classes.get(find(c), "") + re.escape(c)
        several = "".join(f"[{chars}]+|" for chars in sorted(classes.values(), key=len, reverse=True))
        return re.compile(f" *(?:{several}[^ ])| +").findall

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Per text its ids and the source bytes up to the end of each piece (little-endian unsigned 32-bit)."""
        kept, out = self.kept, []
        cuts = [self.cuts(t) or [t] if self.cuts and SPACE not in t else [t] for t in texts]
        firsts = list(self._pieces([c.pop(0) for c in cuts], True))
        new = list(set(chain.from_iterable(cuts)).difference(kept))
        kept.others = dict(zip(new, self._pieces(new, False)))
        for first, own in zip(firsts, cuts):
            rest = list(map(kept.__getitem__, own))
            sizes = np.frombuffer(first[1] + b"".join([r[1] for r in rest]), "<u4")
            out.append((first[0] + b"".join([r[0] for r in rest]), np.cumsum(sizes, dtype="<u4").tobytes()))
        kept.update((c, kept.others[c]) for c in new[:max(0, KEPT_CUTS - len(kept))] if len(c) <= KEPT_LENGTH)
        kept.others = {}
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian unsigned 32-bit), without the space that encoding puts first."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.surfaces.__getitem__, numbers))
        if self.normalise.prefix or self.normalise.squeeze:
            first = next((i for i in numbers if self.surfaces[i]), None)
            if first is not None and self.leads[first]:
                raw = raw[1:]
        return raw.decode("utf-8", _ONE_BY_ONE)


def _model(path: str) -> PieceModel:
    return worker_kept(f"sentencepiece:{path}", lambda: PieceModel(path))


def _in_batches(model: PieceModel, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
    """Encoded texts; no more than BATCH_CHARS characters of them, or one text, are held at a time."""
    batch, chars = [], 0
    for text in texts:
        if batch and chars + len(text) > BATCH_CHARS:
            yield from model.encode(batch)
            batch, chars = [], 0
        batch.append(text)
        chars += len(text)
    yield from model.encode(batch)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, pieces (array of id, begin, end: the source bytes of each).  `path` is a file on every machine."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("text"))

    @per_task
    def work():
        model = _model(path)

        def step(batch):
            rows = []
            for ids, ends in _in_batches(model, batch["text"]):
                ends = np.frombuffer(ends, "<u4").tolist()
                rows.append([{"id": i, "begin": a, "end": b}
                             for i, a, b in zip(np.frombuffer(ids, "<u4").tolist(), [0, *ends], ends)])
            return {"pieces": rows}

        return step

    schema = f"id {texts.schema['id'].dataType.simpleString()}, pieces array<struct<id:int,begin:bigint,end:bigint>>"
    return per_batch(texts, work, schema, reads=["text"]).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", pieces: str = "pieces") -> DataFrame:
    """Per row: id, text (string) of the pieces' ids."""
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{pieces}`")["id"].alias("ids"))

    @per_task
    def work():
        model = _model(path)
        return lambda batch: {"text": [model.decode(np.array(i or [], "<u4").tobytes()) for i in batch["ids"]]}

    schema = f"id {rows.schema['id'].dataType.simpleString()}, text string"
    return per_batch(rows, work, schema, reads=["ids"]).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, digests of its decimal ids, of the text they decode to, and of the pieces' ends.

    Encodes and decodes in one pass, so that ids do not leave the worker.
    spans_sha256 is of the source bytes up to the end of each piece, as
    little-endian unsigned 32-bit integers.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    @per_task
    def work():
        model = _model(path)
        decimal = list(map(str, range(len(model.surfaces))))

        def step(batch):
            made = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "spans_sha256": []}
            for ids, ends in _in_batches(model, batch["text"]):
                numbers = np.frombuffer(ids, "<u4").tolist()
                made["n_tokens"].append(len(numbers))
                made["ids_sha256"].append(sha(",".join(map(decimal.__getitem__, numbers)).encode()))
                made["decoded_sha256"].append(sha(model.decode(ids).encode()))
                made["spans_sha256"].append(sha(ends))
            return made

        return step

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return per_batch(texts, work, schema, reads=["text"])
