"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions alone.

Text and role may hold anything, also the template's own control strings: in
both, backslash, `<`, `#` (and `:` in a role) are written as a backslash and a
letter, so a control string in the output is always one of the template's. The
mapping is one to one and `parse_formatted` undoes it.

Edge cases: null text and null role count as empty; a null turn sorts first;
rows with equal turns are ordered by role and text, so repeated rows are kept
and the order is the same in every run. A null conv_id is a conversation of its
own. An empty table gives an empty result; other columns are not read. One
conversation is one output row, so a row is as long as its conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes, in the order in which they are applied; undone in reverse.
TEXT_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles trained on, and the machine: state -> role -> next state.

    A role missing from a state's row leads to `invalid`, which is never left.
    """

    before_role: str = "### "
    after_role: str = ": "
    end_of_turn: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    machine: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "ready"), ("start", "user", "asked"), ("ready", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    accepting: tuple[str, ...] = ("answered",)


CHAT = Template()


def escaped(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for raw, written in escapes:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescaped(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for raw, written in reversed(escapes):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def format_chats(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, formatted, segments (text, loss), final_state, valid; joined segments are the formatted text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(template.before_role), escaped(t["role"], ROLE_ESCAPES), F.lit(template.after_role))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(head, F.lit(False)), part(escaped(t["text"]), t["role"].isin(*template.loss_roles)),
            part(F.lit(template.end_of_turn), F.lit(False)),
        )

    steps = F.create_map(*[F.lit(x) for state, role, after in template.machine for x in (f"{state}\n{role}", after)])
    step = lambda state, t: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit("\n"), t["role"])), F.lit("invalid"))
    out = chats.select(
        "conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"),
        F.aggregate("turns", F.lit(template.start), step).alias("final_state"),
    )
    return out.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "final_state",
        F.col("final_state").isin(*template.accepting).alias("valid"),
    )


def parse_formatted(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) read back from formatted text."""
    body = F.filter(F.split(formatted, _literal(template.end_of_turn)), lambda x: x != "")
    pattern = rf"(?s)\A{_literal(template.before_role)}([^:]*){_literal(template.after_role)}(.*)\z"
    return F.transform(body, lambda x: F.struct(
        unescaped(F.regexp_extract(x, pattern, 1), ROLE_ESCAPES).alias("role"), unescaped(F.regexp_extract(x, pattern, 2)).alias("text"),
    ))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in " \n" else f"\\{c}" for c in text)
