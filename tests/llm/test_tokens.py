"""BPE and token id files against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from newsloom.llm import bpe, tokenids
from newsloom.llm.pieces import CutEncoder, FlatEncoder, cuts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, " ", "  x", "a  b", "a \n b\n\n  c ", "don't I'll 's", "x" * 3000 + " " + "ab" * 2000, "日本語 テキスト 😀😀",
         "a\x1c b \x1cc", "  \n \t x \r\n y   ", "\x85  z  ", "<|endoftext|> </s>", "é é", "\x00 \x00"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(RANKS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tab1.é'sx日\x85 \x1c😀"), max_size=40), max_size=5))
def test_encoding_is_the_library_s(library, ranks, texts):
    for text, ids in zip(texts, CutEncoder(ranks.encode_cuts, kept_cuts=5)(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert ranks.decode(ids) == text.encode()


@given(st.text(st.sampled_from(" \n\tab\x1c\x85")))
def test_cuts(text):
    assert " ".join(cuts(text)) == text


def documents(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(" \n\ta1.é'sx日ß thing") for _ in range(rng.randrange(300))) for _ in range(60)]
    rows = [(i * 7 % 101, t, "z") for i, t in enumerate(texts)] + [(None, "no id", "z"), (0, "", "z"), (3, "again", "z"), (3, "again", "z")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, ids string")


def test_digests(spark, library):
    rows, df = documents(spark)
    got = bpe.digests(df, RANKS, P.PATTERN, with_ids=True).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(str, (tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.digests(df.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(1, 40))
def test_simple8b(ids, repeat):
    ids = ids * repeat
    payload = tokenids.pack(ids)
    assert tokenids.unpack(payload).tolist() == ids
    b = tokenids.BLOCK
    assert tokenids.unpack(payload, 1, 2).tolist() == ids[b:2 * b]


def test_damage():
    payload = bytearray(tokenids.pack(range(100)))
    payload[-1] ^= 0x40
    with pytest.raises((ValueError, IndexError)):
        tokenids.unpack(bytes(payload))
    with pytest.raises(ValueError):
        tokenids.unpack(b"else" + bytes(payload)[4:])


def test_files(spark, tmp_path, monkeypatch):
    rows, df = documents(spark)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    monkeypatch.setattr(tokenids, "SEGMENT", 100)
    tokenids.write_ids(df.repartition(3), str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    read = tokenids.read_ids(spark, str(tmp_path / "ids"))
    got = sorted(tuple(r) for r in tokenids.id_digests(read).collect() if r.doc_id is not None)
    lengths, want = {}, []
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((i, len(ids) // 4, zlib.crc32(ids)))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted(w for w in want if w[0] is not None)
    all_rows = sorted((tuple(r) for r in tokenids.id_digests(read).collect()), key=lambda r: r[1])
    at = 0
    for doc, start, n, _ in all_rows:
        assert start == at
        at += n
    assert [r[0] for r in all_rows] == [w[0] for w in sorted(want, key=key)] and not lengths
    assert spark.read.parquet(str(tmp_path / "ids")).count() > 5
    tokenids.write_ids(df.limit(0), str(tmp_path / "none"), P.path("byte_bpe_50k.json"))
    assert tokenids.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_ids_of_all_code_points():
    """Cuts, alone and joined by tabs, are held against whole texts on every code point."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{chr(c)}{' a1.'[c % 4]}" for c in points[k:k + 300]) for k in range(0, len(points), 300)]
    texts += ["a  b", " a", "a ", "", "\n x", "a \u00a0b c", "x \n y z", "<|endoftext|> a", "a\tb c\t d.\n e\u2003 f", "x that's.\n\nBe it'll\nBe?\n\n\nNo a1b.\r\nC", "a\u3000 b  "]
    want = [e.ids + [7] for e in library.encode_batch(texts, add_special_tokens=False)]
    for kept in (0, 3, 100_000):
        encoder = FlatEncoder(tokenids._library(path).encode, kept)
        for _ in range(2):
            ids, lengths = encoder(texts, 7)
            assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert [x.tolist() for x in encoder([], 7)] == [[], []]


def test_only_cuts_with_other_signs_are_searched_for_parts(monkeypatch):
    """A space and letters hold no place to part, so nothing is searched for in them."""
    searched = []

    class Pattern:
        @staticmethod
        def split(cut):
            searched.append(cut)
            return safe.split(cut)

    safe = tokenids._SAFE
    encode = tokenids._library(P.path("byte_bpe_50k.json")).encode
    monkeypatch.setattr(tokenids, "_SAFE", Pattern)
    cuts = [" zqword", " zqслово", " zqword,more", "zqfirst", " zq1", " ", ""]
    got = encode(cuts)
    assert searched == cuts[2:]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [list(memoryview(x).cast("I")) for x in got] == [library.encode(c, add_special_tokens=False).ids for c in cuts]


def test_cuts_that_begin_with_any_blank():
    library, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), FlatEncoder(tokenids._library(P.path("byte_bpe_50k.json")).encode, 2)
    texts = [f"a {c}b c" for c in "\t\n\x0b\x1c\x85\xa0\u2003\u3000\u200b\ufeff"] + ["", " ", "  a", "a  ", "\xa0a b", "é x", " \u3000"]
    ids, lengths = encoder(texts, 0)
    ends = lengths.cumsum()
    for text, end, n in zip(texts, ends, lengths):
        assert ids[end - n:end].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text


def test_opening_cuts_are_kept_too():
    asked = []
    encoder = FlatEncoder(lambda cuts: [asked.append(c) or (b"\x05\0\0\0" if c else b"") for c in cuts], 1000)
    for _ in range(2):
        ids, lengths = encoder(["one two", "", "one"], 9)
        assert ids.tolist() == [5, 5, 9, 9, 5, 9] and lengths.tolist() == [3, 1, 2]
    assert sorted(asked) == [" two", "one"]


def test_known_words_are_not_asked_for_again():
    """Words and signs are pieces of their own, so texts of known ones ask the library for nothing."""
    asked, made = [], tokenids._library(P.path("byte_bpe_50k.json"))

    def single(pieces):
        asked.extend(pieces)
        return made.single(pieces)

    encoder = FlatEncoder(lambda pieces: asked.extend(pieces) or made.encode(pieces), 1000, single)
    encoder(["one two, three.\nfour", " one four"], 0)
    assert sorted(asked) == sorted(["one", " two", ",", " three", ".", "\n", "four", " one", " four"])
    asked.clear()
    ids, _ = encoder(pa.array(["x", "four two.\none, three,", "one. one"]).slice(1), 0)
    assert not asked
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert ids.tolist() == [i for t in ("four two.\none, three,", "one. one") for i in [*library.encode(t).ids, 0]]


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0'\u2019\u201c,.!a1sltveré×дЯ日。\u3000\u2003\u200b\u180e\ufeff\u0301\u02bc²_\x00\x7f"),
                        max_size=30), max_size=6), st.integers(0, 30))
def test_pieces_hold_whole_matches(own, texts, kept):
    made = tokenids._library(P.path("byte_bpe_50k.json"))
    encoder = FlatEncoder(made.encode, kept, made.single)
    want = [[*e.ids, 0] for e in own.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, lengths = encoder(texts, 0)
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_letters_behind_any_code_point():
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    shapes = ["a{0}b", "a {0} b", "{0}'s", "'{0}", "1{0}2", ".{0}.", "\n{0}\n", "  {0}  x", "é{0} é"]
    texts = ["".join(shapes[(k + j) % 9].format(c) for j, c in enumerate(points[k:k + 301])) for k in range(0, len(points), 301)]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids, lengths = tokenids._library(P.path("byte_bpe_50k.json"))(texts, 0)
    want = [[*e.ids, 0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_a_model_that_leaves_bytes_out_is_not_asked_for_matches():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert tokenids._matches(library) is not None
    from tokenizers import models

    library.model = models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")])
    assert tokenids._matches(library) is None


def test_batches_of_many_sizes(spark, tmp_path, monkeypatch):
    """Texts beyond a batch, empty ones and null ids come back whole and in order."""
    monkeypatch.setattr(tokenids, "BATCH_BYTES", 50)
    monkeypatch.setattr(tokenids, "SEGMENT", 30)
    rows = [(None, "no id"), (None, None)] + [(i, ["", None, "a, b. " * i, "word" * i, "é\n\n" * i][i % 5]) for i in range(40)]
    tokenids.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), str(tmp_path / "ids"), P.path("byte_bpe_50k.json"))
    got = sorted(tokenids.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: [*library.encode(t or "").ids, 0] for i, t in rows[2:]}
    assert [r.doc_id for r in got] == [None, None, *range(40)]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(list(memoryview(bytes(r.ids)).cast("I")) == want[r.doc_id] and r.n_tokens == len(want[r.doc_id]) for r in got[2:])
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    tokenids.write_ids(empty, str(tmp_path / "empty"), P.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in tokenids.read_ids(spark, str(tmp_path / "empty")).collect()) == [(1, 0, 1), (2, 1, 1)]
