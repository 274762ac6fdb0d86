"""Spelling variants against a plain search."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from newsloom.llm import variants
from newsloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def edits(word, letters):
    out = {word[:k] + word[k + 1:] for k in range(len(word))}
    for c in letters:
        out |= {word[:k] + c + word[k + 1:] for k in range(len(word))}
        out |= {word[:k] + c + word[k:] for k in range(len(word) + 1)}
    return out - {word}


def plain_pairs(words):
    letters, known = set("".join(words)), set(words)
    return sorted((w, v) for w in known for v in edits(w, letters) & known)


def plain_groups(counts, ratio=5):
    near = {w: [] for w in counts}
    for w, v in plain_pairs(list(counts)):
        near[w].append(v)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n, len(near[w]), form[w], None if form[w] is None else counts[form[w]], root))
    return rows


def near(words, begins=None, ends=None):
    begins, ends = (words if x is None else x for x in (begins, ends))
    both = [*begins, *ends]
    return [(both[a], words[b]) for i, j in variants.near_words(words, begins, ends) for a, b in zip(i.tolist(), j.tolist())]


WORDS = st.lists(st.text(alphabet="abé", min_size=1, max_size=9), unique=True, max_size=40)


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_near_words(words):
    assert sorted(near(words)) == plain_pairs(words)


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS)
def test_words_that_are_not_indexed_ask(words, asked):
    want = [(w, v) for w, v in plain_pairs(sorted({*words, *asked})) if w in asked and v in words]
    assert sorted(near(words, asked, asked)) == want


def test_intervals():
    text = "abracadabra$cadabra"
    symbols = np.array([1 if c == "$" else ord(c) - 95 for c in text])
    index = variants.TwoWayIndex(symbols, 5)
    turned = text[::-1]
    state = tuple(np.array([x]) for x in (0, 0, index.size))
    pattern = ""
    for leftwards, c in [(True, "d"), (True, "a"), (False, "a"), (False, "b"), (True, "c"), (False, "r")]:
        state = index.grow(leftwards, np.array([ord(c) - 95]), state)
        pattern = c + pattern if leftwards else pattern + c
        for rank, whole, p in ((state[0], text, pattern), (state[1], turned, pattern[::-1])):
            suffixes = sorted((whole[k:].replace("$", "\x01") for k in range(len(whole) + 1)))
            first = [k for k, s in enumerate(suffixes) if s.startswith(p)]
            assert (rank[0], state[2][0]) == (first[0], len(first))


def test_groups(spark):
    counts = {"station": 900, "staton": 30, "statin": 150, "statio": 5, "stations": 170, "nation": 900, "matter": 7,
              "mattér": 7, "mutter": 40, "x" * 300: 5, "x" * 301: 25, "alone_": 5, "alone!": 5}
    rows = [(w, n - 2, 1) for w, n in counts.items()] + [(w, 2, 1) for w in counts] + [
        (None, 9, 1), ("short", 99, 1), ("rarely", 4, 1), ("rarelx", None, 1)]
    table = spark.createDataFrame(rows, "word string, n bigint, `a.b` int")
    want = plain_groups(counts)
    for limits in ({}, {"shard_words": 7, "key_words": 3}):
        got = variants.spelling_groups(table, **limits).collect()
        assert len(got) == len(counts) and {tuple(r) for r in got} == {
            (r[0], r[1], r[2], r[3], r[4], r[5]) for r in want}
    assert variants.spelling_groups(table.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"shard_words": 500, "key_words": 10}])
def test_pairs_over_shards(spark, limits):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdeé"), rng.integers(5, 12))) for _ in range(300)]
    words = sorted({*base, *(w for b in base[:150] for w in sorted(edits(b, "abc"))[::3])})
    vocabulary = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = sorted((r.word, r.near) for r in variants.near_pairs(vocabulary, **limits).collect())
    assert got == plain_pairs(words)


def test_rows_of_documents(spark):
    rows = [(1, None), (2, ""), (None, "ABCDEFÉ abcdefÉ"), (3, "abcdeÉ " * 3), (3, "abcde1")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, word int")
    got = Counter()
    for r in variants.slipped_words(docs, every=1 << 40).collect():
        got[r.word] += r.n
    assert got == {"abcdefÉ": 2, "abcdeÉ": 3}


def test_query(spark):
    counts = Counter()
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d.doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = QUERIES["op13_spelling_variants"](spark, SF)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert {tuple(r) for r in got.collect()} == plain_groups(counts)
