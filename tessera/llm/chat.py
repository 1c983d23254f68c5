"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame operations only.

The template names, for each role, what opens and closes a turn and whether its text is learnt from.
Texts and roles can hold the template's control strings; ``escape`` makes them harmless and
``unescape`` undoes it exactly: between the first two characters of the template's ``opening`` (``<``
and ``|``) it adds one backslash to as many (none included) as stand there, so that no opening is left
in a text. In roles the first character of ``after_role`` is written as ``%`` and its code. A template of
which turns could still be misread is refused with a ``ValueError`` that tells why.

Null text, role or turn: empty text, empty role, first of the turns. Repeated turns stay, ordered by
turn, role and text. A null conv_id is a conversation of its own. Empty input gives empty output.
Only the four named columns are read. A conversation is one row of the result and so must fit one
task, as it must fit a model's context; no other group meets in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles' texts carry loss, and which role may follow which."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state; what isn't listed leads to ``error`` and stays there.
    transitions: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if len(self.opening) < 2 or self.opening[0] == self.opening[1] or set(self.opening[:2]) & set("\\%"):
            raise ValueError("opening must begin with two different characters, no backslash or percent sign among them")
        a, b = self.opening[:2]
        if not self.after_role or ord(self.after_role[0]) > 0xFF or self.after_role[0] in "%0123456789ABCDEF\\" + a + b:
            raise ValueError("after_role must begin with a character up to 0xFF that is no digit, A to F, percent sign, backslash or one of opening's first two")
        if a + b in self.opening[1:] or a + b in self.after_role or (self.closing + self.opening).find(self.opening) < len(self.closing):
            raise ValueError("opening must not stand in the other marks")
        if self.opening.endswith(a) or self.after_role.endswith(a) or self.closing.endswith(a) or self.closing.startswith(b):
            raise ValueError("no opening may arise where a mark and a text meet")

    @property
    def guard(self) -> tuple[str, str]:
        return self.opening[0], self.opening[1]


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    a, b = template.guard
    return F.regexp_replace(text, rf"\Q{a}\E(\\*)\Q{b}\E", _literal(a) + r"$1\\" + _literal(b))


def unescape(text: Column, template: Template = CHATML) -> Column:
    a, b = template.guard
    return F.regexp_replace(text, rf"\Q{a}\E\\(\\*)\Q{b}\E", _literal(a) + "$1" + _literal(b))


def _literal(c: str) -> str:
    """A character in a replacement."""
    return "\\$" if c == "$" else c


def escape_role(role: Column, template: Template = CHATML) -> Column:
    first = template.after_role[0]
    return F.replace(F.replace(escape(role, template), F.lit("%"), F.lit("%25")), F.lit(first), F.lit(f"%{ord(first):02X}"))


def unescape_role(role: Column, template: Template = CHATML) -> Column:
    first = template.after_role[0]
    return unescape(F.replace(F.replace(role, F.lit(f"%{ord(first):02X}"), F.lit(first)), F.lit("%25"), F.lit("%")), template)


def end_state(turns: Column, template: Template = CHATML) -> Column:
    """The state of the machine after all turns."""
    steps = F.create_map(*[F.lit(x) for state, row in template.transitions.items() for role, to in row.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(turns, F.lit(template.start), lambda state, turn: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit("\n"), turn["role"])), F.lit("error")))


def segments(turns: Column, template: Template = CHATML) -> Column:
    """For each turn what opens it, its escaped text and what closes it, each with its loss flag."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                piece(F.concat(F.lit(template.opening), escape_role(t["role"], template), F.lit(template.after_role)), F.lit(False)),
                piece(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                piece(F.lit(template.closing), F.lit(False)),
            ),
        )
    )


def format_conversations(df: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row for each conversation: conv_id, segments (text and loss flag), formatted, valid."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = df.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = turns.select("conv_id", segments(F.col("turns"), template).alias("segments"), end_state(F.col("turns"), template).isin(*template.final).alias("valid"))
    return out.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, f"\\Q{template.opening}\\E", -1)
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, template.after_role, 1), template).alias("role"),
        unescape(F.substr(p, F.instr(p, template.after_role) + len(template.after_role), F.length(p) - F.instr(p, template.after_role) - len(template.after_role) + 1 - len(template.closing)), template).alias("text"),
    )
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)
