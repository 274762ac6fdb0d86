"""Periodic runs against a plain search."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from newsloom.llm import periodic
from newsloom.llm.queries import QUERIES


SF = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in dropped)).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 30)), max_size=6), max_size=4))
def test_runs(parts):
    docs = [[w for block, times in doc for w in block * times] for doc in parts]
    got = periodic.runs_of([np.array(d, np.int64) for d in docs])
    assert got == [plain_runs(d) for d in docs]


@pytest.mark.parametrize("least, times", [(4, 2), (9, 2), (6, 3), (30, 4)])
def test_runs_of_other_lengths(least, times):
    rng = np.random.default_rng(least * times)
    docs = [np.tile(rng.integers(0, 2, rng.integers(1, 12)), rng.integers(1, 9)) for _ in range(60)]
    assert periodic.runs_of(docs, least, times) == [plain_runs(d.tolist(), least, times) for d in docs]


def test_lce():
    rng = np.random.default_rng(5)
    words = np.r_[np.tile(rng.integers(0, 3, 40), 12), rng.integers(0, 2, 300), 9]
    lce = periodic.Lce(words)
    i, j = rng.integers(0, len(words), (2, 4000))
    i, j = i[i != j], j[i != j]
    plain = [next(k for k in range(len(words)) if max(a, b) + k >= len(words) or words[a + k] != words[b + k])
             for a, b in zip(i.tolist(), j.tolist())]
    assert lce(i, j).tolist() == plain


def test_long_document():
    words = np.r_[np.zeros(120_000, np.int64), np.arange(1, 5), np.tile([7, 8, 9], 20_000)]
    assert periodic.runs_of([words]) == [[(0, 120_000, 1), (120_004, 60_000, 3)]]


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "a " * 30), (3, "ab " * 24), (3, "ab " * 24), (4, "x y " * 23)]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id bigint, text string, runs string, `a.b` int")
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect())
    assert got == [(0, [(0, 30, 1)], "a"), (1, [], ""), (2, [], ""), (3, [(0, 24, 1)], "ab"), (3, [(0, 24, 1)], "ab"),
                   (4, [], " ".join(["x y"] * 23))]
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d.doc_id: plain_row(d.doc_id, d.text) for d in docs}
    assert any(row[0] for row in got.values())
