"""Substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from newsloom.llm import substrings as ss

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=20):
    """rows (id, text) in reference order: id, words, removed, digest."""
    seen, out = {}, []
    split = [WORD.findall(t or "") for _, t in rows]
    for n, ws in enumerate(split):
        for s in range(len(ws) - window + 1):
            seen.setdefault(tuple(ws[s:s + window]), (n, s))
    for n, ((i, _), ws) in enumerate(zip(rows, split)):
        gone = set()
        for s in range(len(ws) - window + 1):
            if seen[tuple(ws[s:s + window])] < (n, s):
                gone |= set(range(s, s + window))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["w", "é", "x,"]) + str(rng.randrange(vocabulary))
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 25, 40, 90]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        ws = []
        for _ in range(rng.randrange(5)):
            kind = rng.randrange(4)
            if kind == 0:
                ws += [word() for _ in range(rng.randrange(60))]
            elif kind == 1:
                ws += rng.choice(passages)
            elif kind == 2 and texts:
                old = WORD.findall(rng.choice(texts))
                at = rng.randrange(len(old) + 1)
                ws += old[at:at + rng.randrange(80)]
            else:
                ws += [word()] * rng.randrange(50)
        texts.append(rng.choice([" ", "\n", " \t"]).join(ws))
    return texts


def test_automaton():
    rng = random.Random(4)
    seqs = [[rng.choice("ab") for _ in range(rng.randrange(30))] for _ in range(20)]
    a = ss.Automaton()
    for n, s in enumerate(seqs):
        a.add(s, lambda i, n=n: (n, i))
    for s in [*seqs, list("abbabababbaab") * 3]:
        for most in (3, 8):
            for i, (length, place) in enumerate(a.matches(s, most)):
                want, where = 0, None
                for k in range(1, min(most, i + 1) + 1):
                    run = s[i - k + 1:i + 1]
                    ends = [(n, e) for n, t in enumerate(seqs) for e in range(k - 1, len(t)) if t[e - k + 1:e + 1] == run]
                    if ends:
                        want, where = k, min(ends)
                assert length == want and (not want or place == where)


@pytest.mark.parametrize("crowd", [2000, 2])
def test_repeats(spark, crowd):
    rows = list(enumerate(corpus(1)))
    rows[7] = (7, None)
    rows.append((99, "tail " * 3000))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, doc string")
    got = sorted(tuple(r) for r in ss.repeat_digests(df, crowd=crowd).collect())
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 500


def test_ids_that_repeat_or_lack(spark):
    texts = corpus(2, 20)
    rows = [(None, texts[0]), (None, texts[1]), (3, texts[0]), (3, texts[0]), (3, None), (1, texts[1] + " " + texts[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in ss.repeat_digests(df).collect()), key=str)
    by_id = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    wanted = []
    for swap in (False, True):  # rows of one id are ordered by a hash of their text
        order = by_id[:]
        if swap:
            order[0], order[1] = order[1], order[0]
        wanted.append(sorted(plain(order), key=str))
    assert got in wanted


def test_empty(spark):
    assert ss.repeat_digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(tuple(r) for r in ss.repeat_digests(docs).collect()) == plain(rows)


def test_known_spans(spark):
    texts = corpus(5, 30)
    reference, rows = texts[:6], texts[6:]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    ref = spark.createDataFrame([(t,) for t in reference], "text string")
    known = set()
    for t in reference:
        ws = WORD.findall(t)
        known |= {tuple(ws[s:s + 20]) for s in range(len(ws) - 19)}
    for r in ss.known_spans(docs, ref, shard_words=60).collect():
        ws = WORD.findall(rows[r.doc_id])
        want = {k for s in range(len(ws) - 19) if tuple(ws[s:s + 20]) in known for k in range(s, s + 20)}
        assert {k for s in r.spans for k in range(s["a"], s["b"])} == want
    with pytest.raises(ValueError):
        ss.known_spans(docs, ref, most_words=10)
