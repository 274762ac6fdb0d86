"""Toxicity: held-out accuracy, sentences, edge cases."""

import math
import random
import zlib

import numpy as np

from newsloom.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in tx.toxicity(docs, labels).collect()]
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    seen = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hits = sum(p and t for p, t in seen)
    assert hits >= 0.9 * sum(t for _, t in seen)
    assert hits >= 0.95 * sum(p for p, _ in seen)


def made(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join("plain" + rng.choice("abcdefgh") * 3 for _ in range(6)) for _ in range(rng.randrange(1, 8))]
        bad = rng.random() < 0.3
        if bad:
            lines.insert(rng.randrange(len(lines) + 1), "You É awful" + rng.choice("xyz") + " thing")
        rows.append((i, ". ".join(lines)))
        labels.append((i, int(bad)))
    return rows, labels


def test_sentences_and_edges(spark):
    rows, labels = made(300, 1)
    odd = [(1000, None), (1001, ""), (1002, "... 12 !"), (None, "You awfulx thing"), (5, rows[5][1]),
           (1003, "plainaaa " * 300_000 + ". You awfuly thing."), (1004, "x" * 3_000_000)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows + odd], "doc_id bigint, text string, score double")
    marks = spark.createDataFrame(labels + [(2, None), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    got = {}
    for r in tx.toxicity(docs, marks).collect():
        got.setdefault(r.doc_id, r)
    for (i, text), (_, toxic) in zip(rows, labels):
        assert got[i].predicted == toxic
        found = [text[int(a):int(b)] for a, b in (s.split(":") for s in got[i].spans.split(",") if s)]
        assert len(found) == toxic and all("awful" in f for f in found)
    assert got[1000].score == got[1001].score == got[1002].score == 0
    assert got[None].held_out and got[None].predicted == 1 and got[1003].predicted == 1
    a, b = map(int, got[1003].spans.split(",")[-1].split(":"))
    assert "awfuly" in odd[5][1][a:b]
    assert tx.toxicity(docs.limit(0), marks).count() == 0
    assert {r.score for r in tx.toxicity(docs, marks.limit(0)).collect()} == {0.0}


def test_the_model_does_not_depend_on_the_order_of_repeated_ids(spark):
    rows, labels = made(200, 2)
    other, _ = made(200, 3)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    twice = [*rows, *other]  # every id has two texts
    models = [
        tx.train(spark.createDataFrame(part, "doc_id bigint, text string").repartition(n), marks)
        for part, n in ((twice, 1), (twice[::-1], 5))
    ]
    assert len(models[0].weights) and (models[0].weights == models[1].weights).all()
    assert (models[0].bias, models[0].shift) == (models[1].bias, models[1].shift)


def test_scores_are_a_noisy_or_over_sentences(spark):
    """The score of a text from its sentences, one after the other, by the same weights."""
    rows, labels = made(200, 4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    for r in tx.score(docs, model).collect():
        clear = 1.0
        for sentence in rows[r.doc_id][1].split("."):
            found = tx._sentences([sentence.encode()], [(0, 0)])
            for z in model.sentence_logits(found):
                clear *= 1 - 1 / (1 + math.exp(-z))
        want = float(model.scores(np.array([-math.log(clear)]))[0])
        assert abs(r.score - want) < 1e-4
