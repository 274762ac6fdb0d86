"""Spelling variants: words one edit apart, by a bidirectional FM-index over a delimited vocabulary.

Two words one inserted, deleted or replaced code point apart agree in the
first half of one of them as a beginning, or in its second half as an end.  So
a word is dealt, by the halves that words of its own and of the neighbouring
lengths would share with it, to shards in which it is indexed, and by its own
two halves to the shards in which it asks.  Shards are bounded: their number
follows the vocabulary, and a half that very many words share is taken apart
into pieces; the words that ask go to all of them.

A shard is the text $word$word$...$ with two FM-indexes, of the text and of the
reversed text, whose intervals are kept in step (`TwoWayIndex`): an interval
of suffix ranks can grow to the left and to the right.  The search scheme of a
half matches it exactly, up to its delimiter, then turns round and extends
across the other half to the other delimiter, allowing one error.  Ranks are
taken on wavelet matrices, for all open branches of many words at once.

A word's form is its near word of largest count (ties: the least word) if that
count is at least `ratio` times its own, else null.  Counts grow by `ratio` on
the way, so following forms ends; its root is the last word reached.

Defined results.  Words that are null or shorter than `least` code points are
no words; counts of repeated rows are added; a null count is 0.  Words may be
of any length.  An empty table gives an empty table.  Only the word and count
columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import per_batch, stored, text_of

LEAST, LEAST_COUNT, RATIO = 6, 5, 5
SHARD_WORDS = 60_000  # indexed words of a shard, on average
KEY_WORDS = 15_000  # indexed words of one half that stay together
_ASKED = 8192  # words searched at once
_END, _MARK = 0, 1  # symbols: the end of the text, the delimiter


class _Ranks:
    """A wavelet matrix: ranks of symbols in a sequence, for many places at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, int]] = []  # ones before each place, number of zeros
        self.bits = bits
        for k in range(bits - 1, -1, -1):
            ones = (symbols >> k & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        count = np.bincount(symbols, minlength=1 << bits)
        #: Where the symbols sorted by value begin, and where each symbol's places begin behind the last level.
        self.first = np.cumsum(count) - count
        places = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        self.base = np.zeros(1 << bits, np.int64)
        self.base[symbols[places]] = places

    def one(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Of a symbol each: its first rank and its number of places in low..high, and the number of lesser symbols there."""
        less = np.zeros(len(low), np.int64)
        for k, (before, zeros) in enumerate(self.levels):
            bit = symbol >> (self.bits - 1 - k) & 1 == 1
            one_low, one_high = before[low], before[high]
            zero_low, zero_high = low - one_low, high - one_high
            less += np.where(bit, zero_high - zero_low, 0)
            low, high = np.where(bit, zeros + one_low, zero_low), np.where(bit, zeros + one_high, zero_high)
        return self.first[symbol] + low - self.base[symbol], high - low, less

    def each(self, low: np.ndarray, high: np.ndarray):
        """Of every symbol in low..high: the row, the symbol, and what `one` tells of it."""
        row, symbol, less = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for before, zeros in self.levels:
            one_low, one_high = before[low].astype(np.int64), before[high].astype(np.int64)
            zero_low, zero_high = low - one_low, high - one_high
            left, right = zero_high > zero_low, one_high > one_low
            row = np.concatenate([row[left], row[right]])
            symbol = np.concatenate([symbol[left] << 1, symbol[right] << 1 | 1])
            less = np.concatenate([less[left], (less + zero_high - zero_low)[right]])
            low = np.concatenate([zero_low[left], zeros + one_low[right]])
            high = np.concatenate([zero_high[left], zeros + one_high[right]])
        return row, symbol, self.first[symbol] + low - self.base[symbol], high - low, less


def _suffixes(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of the sorted suffixes of a text whose last symbol is nowhere else in it."""
    n, width = len(text), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    for k in range(width):
        key = key << bits | padded[k:n + k]
    while True:
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, in_order[1:] != in_order[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        behind = np.zeros(n, np.int64)
        behind[:max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + behind
        width *= 2


class TwoWayIndex:
    """FM-indexes of a text and of its reverse; an interval is (first rank in one, first rank in the other, size)."""

    def __init__(self, text: np.ndarray, bits: int):
        whole, turned = (np.append(x, _END) for x in (text, text[::-1]))
        self.size = len(whole)
        self.places = _suffixes(whole, bits)
        self.left = _Ranks(whole[self.places - 1], bits)
        self.right = _Ranks(turned[_suffixes(turned, bits) - 1], bits)

    def grow(self, leftwards: bool, symbol: np.ndarray, state: tuple) -> tuple:
        """The intervals with one more symbol on their left, or on their right."""
        ahead, other, size = state if leftwards else (state[1], state[0], state[2])
        first, size, less = (self.left if leftwards else self.right).one(symbol, ahead, ahead + size)
        return (first, other + less, size) if leftwards else (other + less, first, size)

    def branch(self, leftwards: bool, state: tuple) -> tuple:
        """Every symbol that the intervals can grow by: the row, the symbol, the new interval."""
        ahead, other, size = state if leftwards else (state[1], state[0], state[2])
        row, symbol, first, size, less = (self.left if leftwards else self.right).each(ahead, ahead + size)
        grown = other[row] + less
        return row, symbol, ((first, grown, size) if leftwards else (grown, first, size))


def _taken(state: tuple, which: np.ndarray) -> tuple:
    return tuple(x[which] for x in state)


def _near(index: TwoWayIndex, halves: Sequence[np.ndarray], others: Sequence[np.ndarray], leftwards: bool):
    """Rows (word asked, first rank) of words one error away: `halves` is matched exactly, `others` behind it.

    Both are symbols in the order of the search, which goes leftwards, or not, over
    the exact half and turns round for the other; each ends with the delimiter.
    """
    sizes = np.array([len(h) for h in halves])
    flat, starts = np.concatenate(halves), np.cumsum(sizes) - sizes
    q = np.arange(len(halves))
    state = (np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.size))
    for k in range(int(sizes.max())):
        going = sizes[q] > k
        grown = index.grow(leftwards, flat[starts[q[going]] + k], _taken(state, going))
        for x, new in zip(state, grown):
            x[going] = new
        alive = state[2] > 0
        q, state = q[alive], _taken(state, alive)
    sizes = np.array([len(h) for h in others])
    flat, starts = np.append(np.concatenate(others), _MARK), np.cumsum(sizes) - sizes
    back = not leftwards
    at, erred, found = np.zeros(len(q), np.int64), np.zeros(len(q), bool), []
    while len(q):
        expected = flat[starts[q] + at]
        straight = np.flatnonzero(erred)  # behind the error: as expected
        next_rows = [(q[straight], at[straight] + 1, index.grow(back, expected[straight], _taken(state, straight)),
                      np.ones(len(straight), bool))]
        free = np.flatnonzero(~erred)
        row, symbol, grown = index.branch(back, _taken(state, free))
        row = free[row]
        same = symbol == expected[row]
        next_rows.append((q[row[same]], at[row[same]] + 1, _taken(grown, same), np.zeros(int(same.sum()), bool)))
        other = ~same & (symbol > _MARK)
        inside = other & (expected[row] != _MARK)  # replaced
        next_rows.append((q[row[inside]], at[row[inside]] + 1, _taken(grown, inside), np.ones(int(inside.sum()), bool)))
        # inserted, or missing: of equal neighbours only the last place counts
        next_rows.append((q[row[other]], at[row[other]], _taken(grown, other), np.ones(int(other.sum()), bool)))
        gone = free[(expected[free] != _MARK) & (expected[free] != flat[starts[q[free]] + at[free] + 1])]
        next_rows.append((q[gone], at[gone] + 1, _taken(state, gone), np.ones(len(gone), bool)))
        q, at, erred = (np.concatenate([r[k] for r in next_rows]) for k in (0, 1, 3))
        state = tuple(np.concatenate([r[2][k] for r in next_rows]) for k in range(3))
        alive = state[2] > 0
        q, at, erred, state = q[alive], at[alive], erred[alive], _taken(state, alive)
        done = at == sizes[q]
        if done.any():
            hit = done & erred
            found.append((q[hit], state[0][hit]))
            q, at, erred, state = q[~done], at[~done], erred[~done], _taken(state, ~done)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


def near_words(words: Sequence[str], begins: Sequence[str], ends: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (number in begins + ends, number in words) of words one edit apart, each pair once.

    Of a word in `begins` those that begin with its first half, of one in
    `ends` those that end with its second half and do not begin with its first.
    """
    if not len(words) or not (len(begins) or len(ends)):
        return
    letters = sorted({c for group in (words, begins, ends) for w in group for c in w})
    number = {c: k + 2 for k, c in enumerate(letters)}
    bits = max(1, (len(letters) + 1).bit_length())
    table = np.zeros(max(map(ord, letters), default=0) + 1, np.int64)
    table[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
    coded = lambda text: table[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    sizes = np.array([len(w) for w in words])
    marks = np.cumsum(sizes + 1) - (sizes + 1)  # the delimiter before each word
    text = np.full(int(sizes.sum()) + len(words) + 1, _MARK, np.int64)
    inner = np.ones(len(text), bool)
    inner[np.append(marks, len(text) - 1)] = False
    text[inner] = coded("".join(words))
    index, mark = TwoWayIndex(text, bits), np.array([_MARK])
    for offset, asked, leftwards in ((0, begins, True), (len(begins), ends, False)):
        for k in range(0, len(asked), _ASKED):
            some = asked[k:k + _ASKED]
            firsts = [np.append(coded(w[:len(w) // 2])[::-1], mark) for w in some]
            seconds = [np.append(coded(w[len(w) // 2:]), mark) for w in some]
            q, rank = _near(index, *((firsts, seconds) if leftwards else (seconds, firsts)), leftwards)
            # the interval is of $word$ in the text: one place, that of its delimiter
            hit = np.searchsorted(marks, index.places[rank])
            pairs = np.unique(np.stack([q, hit], axis=1), axis=0)
            if not leftwards and len(pairs):
                both = [words[v].startswith(some[w][:len(some[w]) // 2]) for w, v in pairs.tolist()]
                pairs = pairs[~np.array(both)]
            yield pairs[:, 0] + offset + k, pairs[:, 1]


def _halves(word: Column) -> Column:
    """(key, asks as a beginning, asks as an end) of the halves that a word shares with words one edit apart."""
    n = F.char_length(word)

    def keys(kind: str, rounded, half) -> Column:
        lengths = F.array_distinct(F.array(*(rounded((n + d) / 2).cast("int") for d in (-1, 0, 1))))
        own = rounded(n / 2)
        return F.transform(lengths, lambda k: F.struct(
            F.concat(F.lit(kind), k.cast("string"), F.lit(":"), half(k)).alias("key"),
            ((k == own) & F.lit(kind == "<")).alias("begins"), ((k == own) & F.lit(kind == ">")).alias("ends")))

    return F.concat(keys("<", F.floor, lambda k: F.substring(word, F.lit(1), k)),
                    keys(">", F.ceil, lambda k: F.substring(word, n - k + 1, k)))


def near_pairs(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """word, near, near_n: the words (word, n; each once) that are one edit apart, each pair in both orders once."""
    parts = stored(vocabulary.select("word", "n", F.explode(_halves(F.col("word"))).alias("h")).select("word", "n", "h.*"), "halves")
    shards = max(1, -(-parts.count() // shard_words))
    # a half of very many words is taken apart: its words are indexed in one piece each and ask in all;
    # a piece is a shard of its own, so that a pair meets in one of them only
    large = parts.groupBy("key").count().where(F.col("count") > key_words).select(
        "key", F.ceil(F.col("count") / key_words).cast("int").alias("pieces"))
    whole = parts.join(large, "key", "left_anti").select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string").alias("shard"), "word", "n", F.lit(True).alias("indexed"), "begins", "ends")
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    pieces = F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.col("begins") | F.col("ends") | (k == own))
    split = parts.join(large, "key").withColumn("k", F.explode(pieces)).select(
        F.concat("key", F.lit("#"), "k").alias("shard"), "word", "n", (F.col("k") == own).alias("indexed"), "begins", "ends")

    def found(counts: dict[str, int], begins: set[str], ends: set[str]):
        words, asked = sorted(counts), [sorted(begins), sorted(ends)]
        for a, b in near_words(words, *asked):
            both = asked[0] + asked[1]
            near = [words[k] for k in b.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([both[k] for k in a.tolist()], pa.string()), pa.array(near, pa.string()),
                 pa.array([counts[w] for w in near], pa.int64())], ["word", "near", "near_n"])

    def run(batches):
        shard, counts, begins, ends = None, {}, set(), set()
        for batch in batches:
            for s, word, n, indexed, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    yield from found(counts, begins, ends)
                    shard, counts, begins, ends = s, {}, set(), set()
                if indexed:
                    counts[word] = n
                if begin:
                    begins.add(word)
                if end:
                    ends.add(word)
        yield from found(counts, begins, ends)

    dealt = whole.unionByName(split).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of word, form: each round doubles the steps that are taken together."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(at.join(step, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if not moved.where("_moved").limit(1).count():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_groups(words: DataFrame, word: str = "word", n: str = "n", least: int = LEAST,
                    least_count: int = LEAST_COUNT, ratio: int = RATIO, shard_words: int = SHARD_WORDS,
                    key_words: int = KEY_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least `least` code points and `least_count` occurrences."""
    counted = words.select(F.col(f"`{word}`").cast("string").alias("word"), F.col(f"`{n}`").cast("bigint").alias("n"))
    vocabulary = stored(counted.where(F.char_length("word") >= least).groupBy("word").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") >= least_count), "vocabulary")
    best = near_pairs(vocabulary, shard_words, key_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    named = stored(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(named.where(F.col("form").isNotNull()))
    return named.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_RUN = "[a-zÀ-ÿ]"


def slipped_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, every: int = 199) -> DataFrame:
    """word, n (partial counts) of the runs `[A-Za-z\\u00C0-\\u00FF]+` in lower case; some lose a code point, by a hash.

    Only A-Z are lowered.  Where `every` divides the crc32 of `<id>:<run>` in a
    document, the run loses the code point at that hash modulo its length there.
    Shorter words than `least` are left out.  A null id has the text `None`.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), text_of(f"`{text}`").alias("text"))
    find, crc = re.compile(f"{_RUN}{{{least},}}").findall, zlib.crc32

    def work(batch):
        total: Counter[str] = Counter()
        for key, value in zip(batch["id"], batch["text"]):
            head = crc(f"{key}:".encode())
            for run, n in Counter(find(value.encode("utf-8", "replace").lower().decode())).items():
                h = crc(run.encode(), head)
                if h % every == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
                total[run] += n
        return {"word": list(total), "n": list(total.values())}

    return per_batch(texts, work, "word string, n bigint")
