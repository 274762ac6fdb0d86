"""SentencePiece encoding, offsets and decoding against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from newsloom.llm import sentpieces
from newsloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentpieces.PieceModel(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", " a", "a ", "a  b", "▁", "▁▁a", "a▁ b", "x 　 y", "<s> a</s>", "<0x41>", "\0 a\t\nb", "𝄞𝄞 é́", "a" * 300]


def own(model, texts):
    return [(np.frombuffer(i, "<u4").tolist(), np.frombuffer(e, "<u4").tolist()) for i, e in model.encode(texts)]


def theirs(library, texts):
    protos = [library.encode(t, return_type="proto") for t in texts]
    return [([p.id for p in x.pieces], [p.end for p in x.pieces]) for x in protos]


def field(number, value):
    size, head = len(value), bytes([number << 3 | 2])
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return head + bytes([size]) + value


def with_rules(prefix, squeeze, name="nmt_nfkc"):
    """The model with another normalisation: the library's own compiled map."""
    rules = sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()
    spec = next(v for k, v in sentpieces._fields(rules) if k == 3)
    compiled = next(v for k, v in sentpieces._fields(spec) if k == 2)
    new = field(2, compiled) + bytes([3 << 3, prefix, 4 << 3, squeeze, 5 << 3, 1])
    with open(PATH, "rb") as f:
        return b"".join(field(k, v) for k, v in sentpieces._fields(f.read()) if k != 3) + field(3, new)


def test_odd_texts():
    assert own(MODEL, ODD) == theirs(LIBRARY, ODD)


def test_code_points():
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(c) + "a "[c % 2] for c in points[k:k + 500]) for k in range(0, len(points), 500)]
    assert own(MODEL, texts) == theirs(LIBRARY, texts)
    assert [MODEL.decode(i) for i, _ in MODEL.encode(texts)] == [LIBRARY.decode(LIBRARY.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\té漢<s>"), st.characters(codec="utf-8")), max_size=40))
def test_texts(text):
    assert own(MODEL, [text]) == theirs(LIBRARY, [text])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(28700, 28720), st.integers(0, 31999)), max_size=12))
def test_decode_any_ids(ids):
    assert MODEL.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids)


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_compiled_map(tmp_path, prefix, squeeze):
    path = tmp_path / "rules.model"
    path.write_bytes(with_rules(prefix, squeeze))
    model, library = sentpieces.PieceModel(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [*ODD, "ﬁne ①② ｶﾞ  é x​   y", " \t ½ 　", "Ａ　Ｂ  ", "㍿ ﷺ a\r\nb"]
    texts += ["".join(map(chr, range(k, k + 40))) for k in range(0x20, 0x3400, 40)]
    assert own(model, texts) == theirs(library, texts)
    assert [model.decode(i) for i, _ in model.encode(texts)] == [library.decode(library.encode(t)) for t in texts]
    assert model.cuts is None


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    with open(PATH, "rb") as f:
        path.write_bytes(b"".join(field(k, v) for k, v in sentpieces._fields(f.read()) if k != 2))
    with pytest.raises(ValueError):
        sentpieces.PieceModel(str(path))


def test_cuts_that_are_not_kept(monkeypatch):
    monkeypatch.setattr(sentpieces, "KEPT_CUTS", 2)
    texts = ["one two  three four, five.one two ", "three " * 40 + "x" * 90]
    assert own(sentpieces.PieceModel(PATH), texts) == theirs(LIBRARY, texts)


def test_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "Hé  wörld"), (3, "Hé  wörld")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, `a.b` int, pieces string")
    encoded = sentpieces.encode(docs, PATH)
    got = {(r.doc_id, tuple((p.begin, p.end) for p in r.pieces)) for r in encoded.collect()}
    assert got == {(1, ()), (2, ()), (None, ((0, 1), (1, 3))), (3, ((0, 1), (1, 3), (3, 4), (4, 6), (6, 9), (9, 11)))}
    back = sorted((r.doc_id or 0, r.text) for r in sentpieces.decode(encoded, PATH).collect())
    assert back == [(0, "a b"), (1, ""), (2, ""), (3, "Hé  wörld"), (3, "Hé  wörld")]
    assert sentpieces.encode(docs.limit(0), PATH).count() == 0


def test_query(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_sentpieces"](spark, SF).collect()}
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids, ends = theirs(LIBRARY, [d.text or ""])[0]
        want[d.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(LIBRARY.decode(ids).encode()),
                          sha(np.array(ends, "<u4").tobytes()))
    assert got == want
