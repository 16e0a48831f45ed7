"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation, in turn order, become text segments with a loss flag
each: an opening mark, the turn's text with control strings escaped, a closing
mark.  The machine's moves are data as well, and so is what a state emits: one
fold over the turns gives the state that each turn leads to, which decides the
turn's marks and loss flag.  A turn out of order, and every one after it, leads
to the error state; there the marks go by the role, and no turn is dropped.  The
fold also reports whether the order is allowed and the first turn that is not.

Everything is column expressions.  A conversation is one row of the result, so
its turns meet in one row; nothing larger is gathered.

Defined results: a null text or role is the empty one; turns with equal numbers
follow in order of role and text, null numbers first; repeated rows are turns of
their own; a null conversation id is a conversation; an empty table gives no
rows.  A role that the template does not know gets the generic marks, which
carry the role's name, and has no loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, the machine's moves and the escape character.

    Marks are at least two characters long and their first character occurs
    nowhere else in a mark, so that no mark can arise where texts and marks meet.
    """

    turns: dict[str, Turn]
    start: str
    moves: dict[tuple[str, str], str]  # (state, role) -> state
    final: frozenset[str]
    other: Turn = Turn("<turn>", "</turn>")
    role_end: str = "<text>"
    escape: str = "\\"
    error: str = field(default="error")

    def emits(self) -> dict[str, str]:
        """The role whose marks a state emits: that of the moves into it."""
        return {state: role for (_, role), state in self.moves.items()}

    def marks(self) -> list[str]:
        every = [m for t in [*self.turns.values(), self.other] for m in (t.open, t.close)]
        return list(dict.fromkeys([*every, self.role_end]))

    def __post_init__(self):
        heads = {m[0] for m in self.marks()}
        for m in self.marks():
            if len(m) < 2 or self.escape in m or heads & set(m[1:]):
                raise ValueError(f"mark {m!r} does not fit")
        if any(self.emits()[state] != role for (_, role), state in self.moves.items()) or self.error in self.emits():
            raise ValueError("all moves into a state have the same role, and none leads to the error state")
        if len(self.escape) != 1 or self.escape in heads:
            raise ValueError("the escape is one character that begins no mark")


INSTRUCT = Template(
    turns={
        "system": Turn("<sys>", "</sys>"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    start="begin",
    moves={
        ("begin", "system"): "instructed",
        ("begin", "user"): "asked",
        ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    final=frozenset({"answered"}),
)


def escaped(text: Column, template: Template) -> Column:
    """Text in which no mark occurs: the escape is doubled and put after a mark's first character."""
    e = template.escape
    out = F.replace(text, F.lit(e), F.lit(e + e))
    for m in template.marks():
        out = F.replace(out, F.lit(m), F.lit(m[0] + e + m[1:]))
    return out


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, "(?s)" + re.escape(template.escape) + "(.)", "$1")


def role_marks(role: Column, template: Template) -> tuple[Column, Column, Column]:
    """(opening mark, closing mark, loss flag) of a role."""
    by_role = lambda pick, other: reduce(
        lambda acc, item: F.when(role == item[0], F.lit(pick(item[1]))).otherwise(acc), template.turns.items(), other
    )
    generic = F.concat(F.lit(template.other.open), escaped(role, template), F.lit(template.role_end))
    return (
        by_role(lambda t: t.open, generic),
        by_role(lambda t: t.close, F.lit(template.other.close)),
        by_role(lambda t: t.loss, F.lit(template.other.loss)),
    )


def segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def turn_segments(turn: Column, state: Column, template: Template) -> Column:
    """What the state that a turn led to emits; in the error state the turn's role decides."""
    opening, closing, loss = role_marks(turn["role"], template)
    for name, role in template.emits().items():
        if role not in template.turns:
            continue  # the generic marks carry the role's name
        known = template.turns[role]
        opening = F.when(state == name, F.lit(known.open)).otherwise(opening)
        closing = F.when(state == name, F.lit(known.close)).otherwise(closing)
        loss = F.when(state == name, F.lit(known.loss)).otherwise(loss)
    no = F.lit(False)
    return F.array(
        segment(opening, no), segment(escaped(turn["text"], template), loss), segment(closing, no)
    )


def machine(turns: Column, template: Template) -> Column:
    """Struct of the state after each turn, the last one, the turns taken and the first wrong turn
    (0-based, null if none)."""

    def move(acc: Column, turn: Column) -> Column:
        state = F.lit(template.error)
        for (origin, role), target in template.moves.items():
            state = F.when((acc["state"] == origin) & (turn["role"] == role), F.lit(target)).otherwise(state)
        wrong = acc["wrong"].isNull() & (state == template.error)
        return F.struct(
            F.concat(acc["states"], F.array(state)).alias("states"),
            state.alias("state"),
            (acc["taken"] + 1).alias("taken"),
            F.when(wrong, acc["taken"]).otherwise(acc["wrong"]).alias("wrong"),
        )

    zero = F.struct(
        F.array().cast("array<string>").alias("states"),
        F.lit(template.start).alias("state"), F.lit(0).alias("taken"), F.lit(None).cast("int").alias("wrong")
    )
    return F.aggregate(turns, zero, move)


def formatted(
    df: DataFrame,
    template: Template = INSTRUCT,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: (id, n_turns, valid, wrong_turn, segments, formatted)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    run = grouped.select("id", "turns", machine(F.col("turns"), template).alias("run"))
    emitted = F.zip_with("turns", "run.states", lambda t, state: turn_segments(t, state, template))
    run = run.select("id", "turns", "run", F.flatten(emitted).alias("segments"))
    return run.select(
        F.col("id").alias(id_col),
        F.size("turns").cast("long").alias("n_turns"),
        (F.col("run.wrong").isNull() & F.col("run.state").isin(*template.final)).alias("valid"),
        F.col("run.wrong").alias("wrong_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted_text: Column, template: Template = INSTRUCT) -> Column:
    """Array of (role, text) from a formatted conversation."""
    every = [*template.turns.values(), template.other]
    ends = "|".join(dict.fromkeys(re.escape(t.close) for t in every))
    chunks = F.filter(F.split(formatted_text, f"(?<={ends})"), lambda c: c != "")

    def between(chunk: Column, opening: str, closing: str) -> Column:
        inner = F.length(chunk) - len(opening) - len(closing)
        return F.substring(chunk, F.lit(len(opening) + 1), inner)

    def parsed(chunk: Column) -> Column:
        inner = between(chunk, template.other.open, template.other.close)
        cut = F.locate(template.role_end, inner)
        out = F.struct(
            unescaped(F.substring(inner, F.lit(1), cut - 1), template).alias("role"),
            unescaped(F.substring(inner, cut + len(template.role_end), F.length(inner)), template).alias("text"),
        )
        for role, t in template.turns.items():
            known = F.struct(
                F.lit(role).alias("role"), unescaped(between(chunk, t.open, t.close), template).alias("text")
            )
            out = F.when(F.startswith(chunk, F.lit(t.open)), known).otherwise(out)
        return out

    return F.transform(chunks, parsed)


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped."""
    texts = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    return F.array_join(texts, "")
