"""Periodic runs of words: difference-cover LCE and a harmonic grid.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and a length of at least max(least, times * q) that no
neighbouring word extends with that period.

Two words q apart match all along a run, on a stretch of at least
g = max(least - q, (times - 1) * q) places, so one of the places 0, g, 2g, ...
lies in it: the grid has n / g places for a period, n log n in all.  From each
place that matches, the longest common extension (LCE) of the two suffixes
behind it and of the two prefixes before it gives the whole stretch.

LCE (`Lce`).  COVER is a difference cover modulo T: for any two positions some
step below T takes both to sampled residues.  Only sampled suffixes are sorted
(T words at once, then by doubling); a query compares the words up to the
synchronised samples and reads the rest as the minimum of the neighbours'
common prefixes between their ranks, from a sparse table.  Prefixes are the
suffixes of the reversed words.

The documents of a batch lie in one array, each behind a separator of its own,
so no extension leaves a document.  Only documents with a place from which
CLOSE words match on one side get the LCE arrays: a run has more than twice as
many matching places, so the others have no run.

Defined results.  A null or empty text has no words, no runs and the empty
collapsed text.  Words are `[^\\x20\\x09-\\x0D]+`.  A word is dropped from the
collapsed text if any run holds it behind that run's first q words.  Rows are
worked on alone: repeated rows give equal rows, null ids stay, empty tables
give empty ones; only the id and text columns are read.  Texts may be of any
length: n words take O(n log n) time and O(n log n) numbers of memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import per_batch, text_of, words_of

#: A perfect difference set, and its modulus.
T, COVER = 13, (0, 1, 3, 9)
LEAST, TIMES = 24, 3
GROUP_WORDS = 200_000  # words of documents worked on together
_PAIRS = 1 << 20  # grid places looked at together

_SLOT = np.full(T, -1)
_SLOT[list(COVER)] = range(len(COVER))
#: The least step that takes residues r and s to sampled ones together.
_STEP = np.array([[next(d for d in range(T) if (r + d) % T in COVER and (s + d) % T in COVER)
                   for s in range(T)] for r in range(T)])


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (high, low)."""
    return np.unique(high * (low.max() + 1) + low, return_inverse=True)[1]


class Lce:
    """Longest common extensions of the suffixes of a sequence whose last word is nowhere else in it."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        whole = -(-n // T) * T + T
        own = words.max(initial=0) + 1 + np.arange(whole + T - n)  # the padding matches nothing
        self.words = np.concatenate([words, own]).astype(np.int64)
        at = np.arange(0, whole, T)[:, None] + np.array(COVER)
        self.samples = at.reshape(-1)
        step, m = len(COVER), len(self.samples)
        block = [self.words[self.samples + k] for k in range(T)]
        order = np.lexsort(block[::-1])
        new = np.zeros(m, bool)
        for column in block:
            column = column[order]
            new[1:] |= column[1:] != column[:-1]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        levels = [rank]  # of the T * 2^k words from each sample
        while rank.max() + 1 < m:
            gap = step << (len(levels) - 1)
            behind = np.zeros(m, np.int64)
            behind[:max(0, m - gap)] = rank[gap:] + 1
            rank = _ranks(rank, behind)
            levels.append(rank)
        self.rank = rank
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        self.table = self._sparse(self._neighbours(order, levels, step))

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray], step: int) -> np.ndarray:
        """Common prefix of each sampled suffix, in order, with the one before it."""
        a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(len(order), np.int64)
        m = len(order)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < m
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            out[1:][same] += T << k
            a[same] += step << k
            b[same] += step << k
        inside = np.flatnonzero(np.maximum(a, b) < m)
        i, j = self.samples[a[inside]], self.samples[b[inside]]
        out[1:][inside] += self._compare(i, j, np.full(len(i), T))
        return out

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on, `most` at most."""
        out, alive = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(T):
            alive = alive[most[alive] > k]
            alive = alive[self.words[i[alive] + k] == self.words[j[alive] + k]]
            if not len(alive):
                break
            out[alive] += 1
        return out

    @staticmethod
    def _sparse(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def _least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of the neighbours' common prefixes first..last."""
        out = np.empty(len(first), np.int64)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            row = self.table[k]
            out[of] = np.minimum(row[first[of]], row[last[of] - (1 << int(k)) + 1])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on (i and j differ)."""
        step = _STEP[i % T, j % T]
        out = self._compare(i, j, step)
        met = np.flatnonzero(out == step)
        a, b = ((x[met] + step[met]) for x in (i, j))
        a, b = (self.rank[x // T * len(COVER) + _SLOT[x % T]] for x in (a, b))
        out[met] += self._least(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def _joined(docs: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents in one array, a separator of its own before each and behind the last; where each begins."""
    top = max((int(d.max()) for d in docs if len(d)), default=0) + 1
    parts = [x for k, d in enumerate(docs) for x in ((top + k,), d)]
    ends = np.cumsum([len(d) + 1 for d in docs])
    return np.concatenate([*parts, (top + len(docs),)]).astype(np.int64), ends - np.array([len(d) for d in docs])


def _grid(sizes: np.ndarray, starts: np.ndarray, least: int, times: int):
    """Chunks of (place, period) of the harmonic grids of all documents."""
    periods = np.where(sizes >= least, sizes // times, 0)
    last = np.cumsum(periods)
    for lo in range(0, int(last[-1]) if len(last) else 0, _PAIRS // 4):
        number = np.arange(lo, min(lo + _PAIRS // 4, int(last[-1])))
        doc = np.searchsorted(last, number, side="right")
        q = number - (last[doc] - periods[doc]) + 1
        g = np.maximum(least - q, (times - 1) * q)
        places = -(-(sizes[doc] - q) // g)
        ends = np.cumsum(places)
        for a in range(0, int(ends[-1]), _PAIRS):
            some = np.arange(a, min(a + _PAIRS, int(ends[-1])))
            of = np.searchsorted(ends, some, side="right") if len(ends) > 1 else np.zeros(len(some), np.int64)
            yield starts[doc[of]] + (some - (ends[of] - places[of])) * g[of], q[of]


def _close(words: np.ndarray, i: np.ndarray, q: np.ndarray, close: int) -> np.ndarray:
    """Which places match, and so do `close` more on their right or on their left."""
    hit = np.flatnonzero(words[i] == words[i + q])
    sides = []
    for way in (1, -1):
        alive = hit
        for k in range(1, close + 1):
            at = i[alive] + way * k  # a separator ends every walk, so none leaves the array
            alive = alive[words[at] == words[at + q[alive]]]
        sides.append(alive)
    return np.union1d(*sides)


def runs_of(docs: Sequence[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Per document (word numbers, 0 or more): its runs (start, length, period) by start, then period."""
    if times < 2 or least < 2:
        raise ValueError("a run repeats at least once")
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    words, starts = _joined(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    close = (min(max(least - q, (times - 1) * q) for q in range(1, least + 1)) - 1) // 2
    found = [(i[k], q[k]) for i, q in _grid(sizes, starts, least, times) if len(k := _close(words, i, q, close))]
    if not found:
        return out
    i, q = (np.concatenate(x) for x in zip(*found))
    # only the documents with such places
    of = np.searchsorted(starts, i, side="right") - 1
    which, of_some = np.unique(of, return_inverse=True)
    some, some_starts = _joined([docs[d] for d in which])
    i = i - starts[of] + some_starts[of_some]
    ahead, back = Lce(some), Lce(some[::-1].copy())
    turned = len(some) - 1
    for k in range(0, len(i), _PAIRS):
        a, p = i[k:k + _PAIRS], q[k:k + _PAIRS]
        right = ahead(a, a + p)
        left = back(turned - (a - 1), turned - (a + p - 1))
        good = left + right >= np.maximum(least - p, (times - 1) * p)
        first = (a - left)[good]
        rows = np.stack([first, left[good] + right[good] + p[good], p[good]], axis=1)
        rows = np.unique(rows, axis=0)
        at = np.searchsorted(some_starts, rows[:, 0], side="right") - 1
        rows[:, 0] -= some_starts[at]
        for d, row in zip(which[at].tolist(), rows.tolist()):
            out[d].append(tuple(row))
    for d in which:
        least_period: dict[tuple[int, int], int] = {}
        for start, length, period in sorted(out[d]):
            least_period.setdefault((start, length), period)  # multiples of the smallest period name the same stretch
        out[d] = sorted(((s, n, p) for (s, n), p in least_period.items()), key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    return b" ".join(words).decode("utf-8", "replace")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST,
              times: int = TIMES) -> DataFrame:
    """Per row: id, runs (array of start, length, period by start, then period), collapsed (text without repeats)."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("text"))

    def work(batch):
        made, group, size = {"runs": [], "collapsed": []}, [], 0

        def close_group():
            ids: dict[bytes, int] = {}
            number, setdefault = count(), ids.setdefault
            docs_ = [np.fromiter(map(setdefault, w, number), np.int64, len(w)) for w in group]
            for words, runs in zip(group, runs_of(docs_, least, times)):
                made["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                made["collapsed"].append(_collapsed(words, runs))

        for value in batch["text"]:
            words = value.encode("utf-8", "replace").split()  # bytes: ASCII blanks only
            group.append(words)
            size += len(words)
            if size >= GROUP_WORDS:
                close_group()
                group, size = [], 0
        close_group()
        return made

    schema = (f"id {texts.schema['id'].dataType.simpleString()}, "
              "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return per_batch(texts, work, schema, reads=["text"]).withColumnRenamed("id", id_col)


def with_echoes(text: Column, key: Column) -> Column:
    """The words of a text; where crc32 of the key is divisible by ten, its tail repeats a stretch of it."""
    h = F.crc32(key.cast("string"))
    words = words_of(text)

    def echo(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.concat(F.slice(words, F.lit(1), a.cast("int")), tail)

    planted = F.array_join(F.get(F.transform(F.array(words), echo), F.lit(0)), " ")
    return F.when((h % 10 == 0) & (F.size(words) > 0), planted).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period, digests of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
