"""The pipeline against brute force, stage by stage, and the whole run."""

import base64
import hashlib

import public_tokenizers as P
import tiktoken
from test_native import by_hand, contained
from test_simhash import plain_components, plain_fingerprint
from test_spans import plain_secrets

import corpus_pipeline as cp
from newsloom.session import scratch_paths

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # the hosts of this table are alike, so only the base rules decide
    want = {i for i, r in rows.items() for n in [by_hand(r.text)] if n[0] >= 20 and 100 * n[4] <= 30 * n[0]}
    after = cp.good_documents(spark, docs, SF)
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == want < set(rows)

    before = sorted(want)
    names = plain_components([(i, plain_fingerprint(rows[i].text)) for i in before])
    want = {i for i, n in zip(before, names) if i == n}
    after = cp.one_of_each(spark, after, SF)
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == want < set(before)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, *_ in contained([(i, rows[i].text) for i in want], items)}
    after = cp.unseen_by_benchmarks(spark, after, SF)
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == want - leaked

    clean = {r.doc_id: r for r in cp.without_secrets(spark, after, SF).collect()}
    assert set(clean) == want - leaked
    for i, r in clean.items():
        if not plain_secrets(rows[i].text):
            assert r == rows[i]
        assert not plain_secrets(r.text) and r.n_chars == len(r.text)

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ran = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert set(ran) == set(clean)
    for i, r in ran.items():
        ids = library.encode_ordinary(clean[i].text)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids), raw, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(clean[i].text.encode()).hexdigest()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows(spark):
    """Nulls, repeated rows, names that clash or hold dots, and a very long text."""
    good = " ".join(f"{w} word{k} stands here" for k, w in enumerate("the and of to in that is it".split() * 2))
    other = " ".join(f"quite{k} another thing{k * k} to say" for k in range(12))
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, good, 0), (1, good, 0), (2, good.upper(), 1), (None, other, 2), (None, other, 2), (4, None, 3), (None, None, 4),
            (5, long, 5), (6, "too short", 6), (7, "a " * 400, 7)]
    docs = spark.createDataFrame([(i, t, "en", None if k % 2 else f"s{k}", None if t is None else len(t), k, "x", "y") for i, t, k in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` int, _row string, c0 string")
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(0, other), (1, good), (5, long)])
    coded = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in coded} == {
        i: hashlib.sha256(t.encode()).hexdigest() for i, t in [(None, other), (1, good), (5, long)]}


def test_run_removes_what_it_no_longer_reads(spark):
    before = set(scratch_paths())
    cp.run(spark, SF).collect()
    assert len(set(scratch_paths()) - before) == 1


def test_no_text_is_sorted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = cp.one_of_each(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "SortMergeJoin" not in plan
