"""Chat formatting: a turn-order machine, a declarative template, loss flags per segment.

A conversation becomes a list of segments (text, loss); their concatenation is
the formatted text.  Control strings of the template begin with "[" or "<";
inside texts these characters are written as entities, so no text can imitate
a control string, and texts read back exactly.

Defined results.  A null text is the empty text; a null role is the empty
role.  Roles that the template does not name are written with a generic mark
and read back, but the machine rejects the conversation (valid is false).
Rows of one conversation are ordered by turn, ties by role, then text, nulls
first; repeated rows are turns of their own.  A null conv_id is a conversation
like any other.  An empty table gives an empty table; only the four named
columns are read.  A conversation is one row by nature: its turns meet in one
task, never those of several.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.bind import bind, computed

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))

FAILED = "failed"


@dataclass(frozen=True)
class Turn:
    """How the turns of one role are written."""

    name: str            # mark in the control string
    loss: bool = False   # whether its text is learnt


@dataclass(frozen=True)
class Template:
    """Roles, and the machine: (state, role) -> state; every other step fails."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("SYS"), "user": Turn("INST"), "assistant": Turn("ANS", loss=True),
    })
    start: str = "start"
    steps: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    accepting: tuple[str, ...] = ("answered",)
    begin: str = "<s>"
    end: str = "</s>"

    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *self.steps.values(), *(state for state, _ in self.steps), FAILED]))

    def emissions(self) -> dict[str, Turn]:
        """What is written for a turn, by the state that it reaches and its role; a failed walk keeps on writing."""
        reached = {(to, role) for (_, role), to in self.steps.items()} | {(FAILED, role) for role in self.turns}
        return {f"{to}>{role}": self.turns[role] for to, role in sorted(reached) if role in self.turns}


def escaped(text: Column) -> Column:
    for plain, entity in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ESCAPES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _walk(turns: Column, template: Template) -> Column:
    """Runs the machine over the roles: the state reached by each turn, in order.

    The states so far are one letter each in a text, which is cheap to extend;
    an array would be copied whole by every turn.
    """
    letter = {state: chr(ord("a") + i) for i, state in enumerate(template.states())}
    steps = _literal_map({f"{letter[state]}>{role}": letter[to] for (state, role), to in template.steps.items()})
    begun = F.struct(F.lit(letter[template.start]).alias("state"), F.lit("").alias("trail"))

    def step(at: Column, turn: Column) -> Column:
        to = F.coalesce(F.element_at(steps, F.concat(at["state"], F.lit(">"), turn["role"])), F.lit(letter[FAILED]))
        return bind(to, lambda t: F.struct(t.alias("state"), F.concat(at["trail"], t).alias("trail")))

    names = _literal_map({short: state for state, short in letter.items()})
    trail = F.aggregate(turns, begun, step, lambda at: at["trail"])
    return F.transform(F.split(trail, "(?<=.)(?=.)"), lambda short: F.element_at(names, short))


def _segments(turn: Column, state: Column, template: Template) -> Column:
    """What the machine emits for a step: opening mark, text, closing mark."""
    emitted = template.emissions()
    names = _literal_map({k: t.name for k, t in emitted.items()})
    learnt = _literal_map({k: t.loss for k, t in emitted.items()})
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return bind(F.concat(state, F.lit(">"), turn["role"]), lambda key: F.array(
        piece(F.concat(F.lit("["), F.coalesce(F.element_at(names, key), F.concat(F.lit("ROLE:"), escaped(turn["role"]))),
                       F.lit("]")), F.lit(False)),
        piece(escaped(turn["text"]), F.coalesce(F.element_at(learnt, key), F.lit(False))),
        piece(F.lit("[/]"), F.lit(False)),
    ))


def format_chats(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, valid, segments array<struct<text, loss>>, formatted."""
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("_turn"),
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    frame = lambda mark: F.array(F.struct(F.lit(mark).alias("text"), F.lit(False).alias("loss")))
    walked = computed(turns, ["conv_id", "_turns"], {"_states": _walk(F.col("_turns"), template)})
    made = computed(walked, ["conv_id", "_states"], {"segments": F.concat(
        frame(template.begin),
        F.flatten(F.zip_with("_turns", "_states", lambda turn, state: _segments(turn, state, template))),
        frame(template.end),
    )})
    valid = F.element_at("_states", -1).isin(list(template.accepting))
    return made.select("conv_id", valid.alias("valid"), "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads formatted conversations back: conv_id, valid, turns array<struct<role, text>>, learnt (unescaped).

    Turns come from the formatted text alone, learnt texts from the segments' loss flags.
    """
    turn = r"\[(" + "|".join(t.name for t in template.turns.values()) + r"|ROLE:[^\[\]<]*)\]([^\[\]<]*)\[/\]"
    roles = _literal_map({t.name: r for r, t in template.turns.items()})
    extract = lambda group: F.regexp_extract_all("formatted", F.lit(turn), F.lit(group))
    named = lambda mark: F.coalesce(F.element_at(roles, mark), unescaped(F.substring(mark, 6, 2**31 - 1)))
    parsed = computed(formatted, ["conv_id", "valid", "formatted", "segments"], {"_marks": extract(1), "_texts": extract(2)})
    return parsed.select(
        "conv_id", "valid",
        F.zip_with("_marks", "_texts", lambda m, t: F.struct(named(m).alias("role"), unescaped(t).alias("text"))).alias("turns"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])).alias("learnt"),
        "formatted",
    )


def chat_digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digest columns of the conversations as read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = computed(read_chats(formatted, template), ["conv_id", "valid"], {
        "n_turns": F.size("turns").cast("bigint"), "_all": F.array_join(lines, ""),
        "_learnt": F.array_join("learnt", ""), "formatted_chars": F.length("formatted").cast("bigint"),
    })
    return back.select(
        "conv_id", "n_turns", F.sha2("_all", 256).alias("turns_sha256"),
        F.length("_learnt").cast("bigint").alias("loss_chars"), F.sha2("_learnt", 256).alias("loss_sha256"),
        "formatted_chars", "valid",
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, role || chr(10) || text || chr(10) AS line, CASE WHEN role = 'assistant' THEN text END AS learnt,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS step,
    length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'))
      + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 5 ELSE 7 + length(
          replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) END
      + 3 AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(learnt, '' ORDER BY turn NULLS FIRST, role, text), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(learnt, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  (sum(chars) + 7)::BIGINT AS formatted_chars,
  regexp_matches(string_agg(step, '' ORDER BY turn NULLS FIRST, role, text), '^s?(ua)+$') AS valid
FROM t GROUP BY conv_id
"""
