"""Quality rules, chat formatting and decontamination: edge cases beside the SQL checks of tests/test_oracle.py."""

import hashlib
import random

import pytest

from newsloom.llm import chat, decontaminate, quality


def by_hand(text):
    ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    wins = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    covered = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_rule_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "x y " * 40, "a b\na b\n a b\n\n\n", "é# *$|", "\x0bz\x0c" * 9, "w" * 200_000,
             " ".join(rng.choice("abc") for _ in range(60)), "    x"]
    rows = [(i, t, None if i % 3 else "h", 1, 2) for i, t in enumerate(texts)] + [(1, "", "h", 1, 2)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _words int, kept int")
    got = sorted(tuple(r)[:6] for r in quality.quality_rules(df).collect())
    assert got == sorted((i, *by_hand(t)) for i, t, *_ in rows)
    assert quality.quality_rules(df.limit(0)).count() == 0
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and quality.keep_good(df.limit(0)).count() == 0


def test_hosts(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(f"bad{i}", i, "too short") for i in range(60)] + [(f"good{i}", 100 + i, good) for i in range(60)]
    rows = [(i, t, "junk" if i < 60 else "fine") for _, i, t in rows] + [(500, good, "junk"), (501, good, None), (502, "x", "fine")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id for r in quality.quality_rules(df).collect() if r.kept}
    assert kept == {100 + i for i in range(60)} | {501}
    assert {r.doc_id for r in quality.keep_good(df).collect()} == kept


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "[INST] &amp; </s>\n[/]"), (1, 1, "assistant", "[INST] &amp; </s>\n[/]"),
    (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", " a "), (3, 5, None, "x"), (3, 4, "to]ol[/]", "y&lt;"),
    (4, 0, "assistant", "x" * 100_000), (None, 0, "user", "n"), (None, 0, None, None),
]


def test_chat(spark):
    df = spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, segments string")
    made = chat.format_chats(df)
    assert {r.conv_id: r.valid for r in made.collect()} == {1: False, 2: True, 3: False, 4: False, None: False}
    got = {r.conv_id: r for r in chat.chat_digests(made).collect()}
    for conv in {t[0] for t in TURNS}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert made.count() == 5 and chat.format_chats(df.limit(0)).count() == 0
    for r in made.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    plan = chat.chat_digests(made)._jdf.queryExecution().optimizedPlan().toString()
    assert all(state in plan for state in chat.Template().states())  # the machine is part of the query


def test_chat_machine_with_a_template_of_its_own(spark):
    """What is written for a turn follows the state that it reaches; a long walk stays linear enough."""
    own = chat.Template(
        turns={"q": chat.Turn("Q"), "a": chat.Turn("A", loss=True)}, start="s",
        steps={("s", "q"): "open", ("open", "q"): "open", ("open", "a"): "done"}, accepting=("done",), begin="<b>", end="</e>")
    turns = [(1, 0, "q", "x"), (1, 1, "q", "y"), (1, 2, "a", "z"), (2, 0, "a", "w"), (2, 1, "q", "v"), (2, 2, "other", "[")]
    turns += [(3, i, "a" if i == 20_000 else "q", "t") for i in range(20_001)]
    made = chat.format_chats(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"), own)
    got = {r.conv_id: (r.valid, r.formatted, [s.text for s in r.segments if s.loss]) for r in made.collect()}
    assert got[1] == (True, "<b>[Q]x[/][Q]y[/][A]z[/]</e>", ["z"])
    assert got[2] == (False, "<b>[A]w[/][Q]v[/][ROLE:other]&#91;[/]</e>", ["w"])
    assert got[3][0] and got[3][2] == ["t"] and len(got[3][1]) == 20_001 * 7 + 7


def contained(docs, items, n=5, share=0.8):
    ws = lambda t: [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (t or "").lower()).split(" ") if w]
    grams = lambda w, k: {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for item in {i for i, _ in items}:
        want = set()
        for _, t in (x for x in items if x[0] == item):
            w = ws(t)
            want |= {(min(len(w), n), g) for g in grams(w, min(len(w), n))} if w else set()
        for doc in {d for d, _ in docs}:
            have = {(k, g) for _, t in (x for x in docs if x[0] == doc) for k in range(1, n + 1) for g in grams(ws(t), k)}
            if want and len(want & have) >= share * len(want) - 1e-9:
                out.add((doc, item, len(want & have), len(want)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_items(spark, seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 12, 30, 70])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "A b\tC d e f"), (102, "A b\tC d e f"), (None, "p q r s t u v")]
    docs = []
    for d in range(40):
        ws = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if part:
                    part[rng.randrange(len(part))] = word()
            ws += part
        docs.append((d, " ".join(ws)))
    docs += [(0, docs[1][1]), (None, items[3][1]), (90, None), (91, "a B c\nd E f"), (92, "long " * 50_000 + "p q r s t u v")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, item long")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, id long")
    got = {tuple(r) for r in decontaminate.contained_items(d, b).collect()}
    assert got == contained(docs, items) and len(got) > 20
    left = decontaminate.without_items(d, b)
    assert left.columns == d.columns
    leaked = {g[0] for g in got}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in leaked)


def test_rows_of_one_id_are_judged_alone(spark):
    """A null or shared id takes no clean row along, and hides no item."""
    docs = [(None, "a b c d e f"), (None, "clean one"), (None, "p q r s"), (7, "a b c d e f"), (7, "clean two"), (8, "g h i j k l")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(None, "a b c d e f"), (None, "g h i j k l"), (1, "p q r s t u")], "item_id bigint, text string")
    left = [(r.doc_id, r.text) for r in decontaminate.without_items(d, b).collect()]
    assert sorted(left, key=str) == [(7, "clean two"), (None, "clean one"), (None, "p q r s")]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.contained_items(d.limit(0), b).count() == 0
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0
    assert decontaminate.without_items(d, b.limit(0)).count() == 1


def test_large_benchmark_is_not_broadcast(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "x")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b c d e f"), (None, "x")], "item_id bigint, text string")
    want = {tuple(r) for r in decontaminate.contained_items(d, b).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in decontaminate.contained_items(d, b).collect()} == want == {(1, 1, 2, 2), (2, None, 1, 1)}
    assert decontaminate.without_items(d, b).count() == 0
