"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from newsloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).translate({i: 32 for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, max_bits=4):
    """rows: (id, fp); component names by search over all pairs."""

    names = {i: r[0] for i, r in enumerate(rows)}
    root = {i: i for i in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in names:
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= max_bits:
                root[find(i)] = find(j)
    least = {}
    for i in names:
        if names[i] is not None:
            least[find(i)] = min(least.get(find(i), names[i]), names[i])
    return [least.get(find(i)) for i in names]


def test_fingerprint():
    texts = ["", " \n", "one", "a b c", "a b c d", "A b C d e\tf\x0bg", "é Ä ß " * 50, "x " * 300, "x" * 100_000]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("max_bits,most", [(4, 4096), (4, 3), (3, 3), (1, 2), (0, 3)])
def test_links_join_the_same(spark, max_bits, most):
    rng = random.Random(max_bits * 10 + most)
    prints = {rng.getrandbits(64) for _ in range(60)}
    core = rng.getrandbits(64)
    for _ in range(60):  # a dense group, and chains that leave it
        prints.add(core ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}))
        core2 = core ^ (rng.getrandbits(16) << 20)
        prints.add(core2)
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    got = [(r.a, r.b) for r in simhash.links(df, max_bits, most).collect()]
    for a, b in got:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= max_bits
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    want = plain_components(list(zip(range(len(prints)), prints)), max_bits)
    groups = {}
    for p, w in zip(signed, want):
        groups.setdefault(find(p), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


ROWS = [
    (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (3, "A b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (9, None), (7, ""), (8, " \t "), (None, "alone and without an id"), (None, ""), (2, "something else altogether, you see"),
    (2, "something else altogether, you see"), (11, "w " * 50_000),
]


def test_near_duplicates(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id bigint, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_digests(
        simhash.near_duplicates(df)).collect()), key=str)
    prints = [(i, plain_fingerprint(t)) for i, t in ROWS]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=str)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id bigint, text string, _name string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 7, 11]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_of_each_component_whatever_the_ids(spark):
    """Rows that share an id with different texts: each component keeps exactly one row."""
    a, b = "one two three four five six seven", "entirely different words stand in this other text"
    for rows in ([(5, a), (5, b), (9, b)], [(5, a), (5, b), (3, b)], [(None, a), (None, b), (None, b)], [(5, a), (5, a), (5, b)]):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert sorted(r.text for r in kept) == [b, a], rows


def test_keep_one_joins_alike_at_every_size(spark):
    """A join that changes with the number of rows that go makes the shuffle grow faster than the documents."""
    df = spark.createDataFrame([(i, f"text number {i % 7} with some words of its own {i % 7}") for i in range(40)], "doc_id bigint, text string")
    kept = simhash.keep_one(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "LeftAnti" in plan and "BroadcastExchange" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(r) for r in plain_classes(df)})


def plain_classes(df):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
    classes = {}
    for (i, _), c in zip(rows, plain_components(rows)):
        classes.setdefault(c, []).append(i)
    return classes.values()


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == dict(zip((r[0] for r in rows), plain_components(rows)))
    assert docs.count() == len(got) and any(k != v for k, v in got.items())
