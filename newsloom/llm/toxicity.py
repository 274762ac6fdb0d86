"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence is toxic with p = sigmoid(bias +
the weights of its words); the document with noisy-or, 1 - prod(1 - p).  Only
documents have labels: the gradient of the document's loss reaches a sentence
in proportion to its own p, so the offending sentences of a toxic document
take the blame and are found again when documents are scored.

Features of a word are hashes of its beginnings of 4, 5 and 6 bytes, the whole
word standing for those it is too short for, so that forms of one stem share
their weights; words are runs of ASCII letters and non-ASCII bytes, ASCII
lower-cased.  Features of few documents, or not more frequent in toxic ones,
weigh nothing.  Sentences end at . ! ? and line ends.

The model is fitted to a bounded sample: of the labelled documents that may be
learnt from, the SAMPLE with the least hash of their id among those of at most
SAMPLE_CHARS characters.  Every document is scored over its whole text.

Defined results.  A text without words, or null, scores 0.  Without labelled
documents of both kinds every score is 0.  A null id is held out.  Repeated
rows are scored alike; a document with several labels is learnt from once,
as toxic if one says so, and one with several texts by the text of the least
hash; null labels are none.  Empty tables give empty
tables.  Only the named columns are read.  Long texts are worked through in
pieces of CHUNK bytes, cut between words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import per_batch, per_task, text_of

SAMPLE = 8000
SAMPLE_CHARS = 20_000
THRESHOLD = 0.7
SIZE_BITS = 18
BEGINNINGS = (4, 5, 6)
CHUNK = 1 << 20
_QUARTERS = 4  # parts of the sample; each is scored by the fit without it, to place the threshold
_TASKS = 16  # tasks that prepare the sample

_bytes = np.arange(256)
_IN_WORD = ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
_ENDS = np.isin(_bytes, list(b".!?\n"))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _word_features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its features (one row per word)."""
    inside = np.r_[False, _IN_WORD[raw], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    mixed = np.zeros(len(starts), np.uint64)
    begun = [np.zeros(len(starts), np.uint64) for _ in BEGINNINGS]
    live = np.arange(len(starts))
    for k in range(BEGINNINGS[-1]):
        live = live[sizes[live] > k]
        mixed[live] = (mixed[live] ^ raw[starts[live] + k]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
        for n, at in enumerate(BEGINNINGS):
            if k + 1 == at:
                begun[n][live] = mixed[live] + np.uint64(n + 1)
    for n, at in enumerate(BEGINNINGS):  # a word that ends before is told once, by itself
        short = sizes <= (BEGINNINGS[n - 1] if n else 0)
        begun[n] = np.where(short, np.uint64(0), np.where(sizes < at, mixed, begun[n]))
    features = np.stack(begun, axis=1)
    place = (features * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SIZE_BITS)
    return starts, np.where(features == 0, 0, place).astype(np.int64)  # feature 0 weighs nothing


def _chunks(texts: list[str]):
    """Bytes of about CHUNK, the documents in them and where these begin."""
    parts, docs, size = [], [], 0
    for number, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace").lower()
        at = 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= CHUNK else max(
                at + 1, *(raw.rfind(c, at, at + CHUNK) + 1 for c in (b".", b"\n")), 0)
            if end <= at + 1 and len(raw) - at > CHUNK:  # one endless sentence: between words, else between bytes
                blank = raw.rfind(b" ", at, at + CHUNK) + 1
                end = blank if blank > at else at + CHUNK
            parts.append(raw[at:end])
            docs.append((number, at))
            size += end - at + 1
            at = end
            if size >= CHUNK:
                yield parts, docs
                parts, docs, size = [], [], 0
    if parts:
        yield parts, docs


@dataclass
class Sentences:
    """The sentences with words in a chunk: features by word, and each sentence's document and bytes there."""

    features: np.ndarray
    sentence: np.ndarray  # of each word
    doc: np.ndarray       # of each sentence
    start: np.ndarray
    end: np.ndarray


def _sentences(parts: list[bytes], docs: list[tuple[int, int]]) -> Sentences:
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    starts, features = _word_features(raw)
    ends = np.flatnonzero(_ENDS[raw])
    at = np.searchsorted(ends, starts)
    used, sentence = np.unique(at, return_inverse=True)
    part = np.searchsorted(begins, ends[used], side="right") - 1
    first = np.where(used > 0, ends[used - 1] + 1, 0)
    number, offset = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
    shift = offset[part] - begins[part]
    return Sentences(features, sentence, number[part], first + shift, ends[used] + shift)


@dataclass
class Model:
    weights: np.ndarray  # float32 by feature; empty: nothing was learnt
    bias: float = 0.0
    shift: float = 0.0   # added to a document's logit

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        return np.bincount(s.sentence, self.weights[s.features].sum(axis=1), len(s.doc)) + self.bias

    def scores(self, clear: np.ndarray) -> np.ndarray:
        """Of documents, from the sums of -log(1 - p) of their sentences."""
        return np.where(clear > 0, 1 / (1 + np.exp(np.clip(-_logits(clear) - self.shift, -700, 700))), 0.0)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _logits(clear: np.ndarray) -> np.ndarray:
    """log(P / (1 - P)) of P = 1 - exp(-clear)."""
    clear = np.maximum(clear, 1e-300)
    return np.where(clear > 30, clear, np.log(np.expm1(np.minimum(clear, 30))))


def _shift(logits: np.ndarray, labels: np.ndarray, threshold: float) -> float:
    """Moves the cut that parts documents outside the fit best, the widest if several do, to the threshold."""
    order = np.argsort(logits, kind="stable")
    logits, labels = logits[order], labels[order]
    right = np.cumsum(1 - 2 * labels)[:-1]  # clean below less toxic below, at each cut
    wide = logits[1:] - logits[:-1]
    if not len(right) or labels.min() == labels.max():
        return 0.0
    best = np.flatnonzero(right == right[wide > 0].max()) if (wide > 0).any() else []
    if not len(best):
        return 0.0
    cut = best[np.argmax(wide[best])]
    return float(np.log(threshold / (1 - threshold)) - (logits[cut] + logits[cut + 1]) / 2)


def fit(features, sentence, doc, labels, fitted, steps: int = 200, rate: float = 0.15, decay: float = 1e-5,
        least_seen: int = 3, least_lift: float = 4.0, told: float = 0.4) -> Model:
    """Fits the weights to document labels.  features by word, sentence of each word, doc of each sentence.

    Documents that are not `fitted` have no words here and no blame.  A step is told only a share of the features, so that each learns to do
    without the others: an unseen form of a known stem lacks the longer ones.
    """
    labels = np.asarray(labels, np.float64)
    if not len(sentence) or labels[fitted].min() == labels[fitted].max():
        return Model(np.zeros(0, np.float32))
    size, n_docs = 1 << SIZE_BITS, len(labels)
    width = features.shape[1]
    # how often a feature is seen, over sentences that differ: copies of a sentence say nothing more
    said = np.zeros(len(doc), np.uint64)
    for c in range(width):  # a column at a time, as whole tables of 64-bit numbers take much memory
        np.add.at(said, sentence, features[:, c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7))
    first = np.zeros(len(doc), bool)
    first[np.unique(said, return_index=True)[1]] = True
    of_word = first[sentence]
    seen = np.unique(np.concatenate([
        np.unique(sentence[of_word].astype(np.int64) * size + features[of_word, c]) for c in range(width)]))
    total = np.bincount(seen % size, minlength=size)
    toxic = np.bincount(seen % size, labels[doc[seen // size]], size)
    n_toxic = labels[doc[first]].sum()
    lift = ((toxic + 0.5) / (n_toxic + 1)) / ((total - toxic + 0.5) / (first.sum() - n_toxic + 1))
    used = (total >= least_seen) & (lift >= least_lift)
    used[0] = False
    weights, bias = np.zeros(size), -6.0
    keep = used[features]
    all_flat, all_owner = features[keep], np.repeat(sentence, keep.sum(axis=1))
    chance = np.random.default_rng(0)
    moment, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        keep = chance.random(len(all_flat), np.float32) < told
        flat, owner = all_flat[keep], all_owner[keep]
        z = np.bincount(owner, weights[flat], len(doc)) + bias
        clear = np.exp(-np.bincount(doc, _softplus(z), n_docs))        # prod(1 - p)
        blame = np.where(labels > 0, -clear / np.maximum(1 - clear, 1e-9), 1.0) * fitted
        slope = blame[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.r_[np.bincount(flat, slope[owner], size), slope.sum()] / n_docs
        grad[:-1] += decay * weights
        moment = 0.9 * moment + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        change = rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 2e-3)
        weights -= np.where(used, change[:-1], 0)
        bias -= float(change[-1])
    return Model(weights.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model learnt from a bounded sample of the labelled documents that are not held out.

    Each quarter of the sample is left out of one fit, which runs as a task,
    and scored by it, to place the threshold; the model is the mean of the fits.
    """
    ids = F.col(id_col).cast("bigint")
    known = labels.where(F.col(label).isNotNull()).select(ids.alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(ids.alias("id"), text_of(text).alias("text")).where(F.length("text") <= sample_chars)
    # a few more ids than the sample, as some documents are too long; bounded either way
    picked = known.orderBy(F.xxhash64("id"), "id").limit(2 * sample)
    one = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    # the limit leaves one partition; the sample is worked on by more
    rows = one.orderBy(F.xxhash64("id"), "id").limit(sample).repartition(_TASKS, "id")

    def work(batch):
        out = {"y": batch["y"], "features": [], "sizes": []}
        for t in batch["text"]:
            found = [_sentences(*c) for c in _chunks([t])]
            out["features"].append(b"".join(s.features.astype("<i4").tobytes() for s in found))
            out["sizes"].append(b"".join(np.bincount(s.sentence).astype("<i4").tobytes() for s in found))
        return out

    found = per_batch(rows, work, "id bigint, y int, features binary, sizes binary", reads=["y", "text"])
    quarters = found.withColumn("place", F.xxhash64("id")).withColumn("quarter", F.explode(F.array(*map(F.lit, range(_QUARTERS)))))
    fits = quarters.groupBy("quarter").applyInPandas(
        _fit_without, "weights binary, bias double, labels array<double>, logits array<double>").collect()
    if not fits:
        return Model(np.zeros(0, np.float32))
    weights = [np.frombuffer(r["weights"], np.float32) for r in fits]
    labels, logits = (np.concatenate([np.array(r[c]) for r in fits]) for c in ("labels", "logits"))
    return Model(np.mean(weights, axis=0), float(np.mean([r["bias"] for r in fits])), _shift(logits, labels, THRESHOLD))


def _fit_without(key, sample):
    """The fit of the sample without one quarter, and this quarter's logits.  The sample is bounded, so a task holds it."""
    import pandas as pd

    sample = sample.sort_values(["place", "id"])
    features = np.concatenate([np.frombuffer(f, "<i4") for f in sample["features"]])
    features = features.reshape(-1, len(BEGINNINGS))
    sizes = [np.frombuffer(s, "<i4") for s in sample["sizes"]]
    doc = np.repeat(np.arange(len(sample)), [len(s) for s in sizes])
    sentence = np.repeat(np.arange(len(doc)), np.concatenate(sizes))
    labels = sample["y"].to_numpy().astype(np.float64)
    fitted = np.arange(len(sample)) % _QUARTERS != key[0]
    some = fitted[doc][sentence]
    model = fit(features[some], sentence[some], doc, np.where(fitted, labels, 0), fitted)
    if not len(model.weights):
        return pd.DataFrame({"weights": [], "bias": [], "labels": [], "logits": []})
    z = np.bincount(sentence, model.weights[features].sum(axis=1), len(doc)) + model.bias
    logits = _logits(np.bincount(doc, _softplus(z), len(sample)))
    return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias],
                         "labels": [labels[~fitted].tolist()], "logits": [logits[~fitted].tolist()]})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", offending: float = 0.5) -> DataFrame:
    """Per document: id, score, spans (sentences with p of at least `offending`, start:end in code points, joined)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.shift))  # 2^SIZE_BITS numbers
    bound = float(np.log(offending / (1 - offending)))

    @per_task
    def work():
        own = Model(*sent.value)

        def step(batch):
            texts = batch["text"]
            clear, spans = np.zeros(len(texts)), [[] for _ in texts]
            for parts, docs_ in _chunks(texts) if len(own.weights) else ():
                s = _sentences(parts, docs_)
                z = own.sentence_logits(s)
                clear += np.bincount(s.doc, _softplus(z), len(texts))
                for k in np.flatnonzero(z >= bound):
                    spans[s.doc[k]].append((int(s.start[k]), int(s.end[k])))
            return {"score": own.scores(clear).tolist(), "spans": [_in_code_points(t, x) for t, x in zip(texts, spans)]}

        return step

    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, spans string"
    return per_batch(rows, work, schema, reads=["text"]).withColumnRenamed("id", id_col)


def _in_code_points(text: str, spans: list[tuple[int, int]]) -> str:
    """Byte ranges of the text's UTF-8 as code points."""
    if not spans:
        return ""
    raw = text.encode("utf-8", "replace")
    out, at, points = [], 0, 0
    for a, b in sorted(spans):
        points += len(raw[at:a].decode("utf-8", "ignore"))
        size = len(raw[a:b].decode("utf-8", "ignore"))
        out.append(f"{points}:{points + size}")
        at, points = b, points + size
    return ",".join(out)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
             threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, held_out, score, predicted (1 at or above the threshold), spans."""
    found = score(docs, train(docs, labels, id_col, text, label), id_col, text)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
