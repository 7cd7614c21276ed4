"""Chat formatting: a finite-state machine over roles and a declarative template.

Conversations are gathered by one shuffle on the conversation id; the rest is expressions over
the ordered turns. A conversation is one row of the result, so its turns meet in one task: the
digest of a conversation can't be split. Sizes of conversations, not their number, bound memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.columns import let


@dataclass(frozen=True)
class Template:
    """How turns are written. `escapes` maps each control character to what stands for it inside
    a text: the escape character, which is itself the first in the map, and a letter. What is
    written can be read back for every text and role, or the template is refused: the first
    characters of `after_role` and `close` must be among the control characters, so neither can
    begin inside an escaped text, and `open` must not run into them."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    titles: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: tuple = ("assistant",)
    escapes: tuple = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
    #: The machine: from each state, the roles that may follow. "" is the start.
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: States in which a conversation may end.
    final: tuple = ("assistant",)

    def __post_init__(self) -> None:
        plain = [p for p, _ in self.escapes]
        mark = plain[0] if plain else ""
        letters = [w[1:] for _, w in self.escapes]
        wrong = None
        if not plain or any(len(p) != 1 for p in plain) or len(set(plain)) < len(plain):
            wrong = "control characters must be single and distinct, the escape character first"
        elif any(w[:1] != mark for _, w in self.escapes) or any(len(x) != 1 or not x.isalnum() or x in [*plain, FOREIGN] for x in letters) or len(set(letters)) < len(letters):
            wrong = f"what stands for a control character is the escape character and a letter of its own, not {FOREIGN}"
        elif any(m[:1] not in plain for m in (self.after_role, self.close)):
            wrong = "after_role and close must begin with a control character"
        elif any(c in plain for t in self.titles.values() for c in t) or len(set(self.titles.values())) < len(self.titles):
            wrong = "titles must be distinct and free of control characters"
        elif any(a.startswith(b) or b.startswith(a) for m in (self.open, self.after_role) for i in range(len(m)) for a, b in [(m[i:], self.close)]):
            wrong = "close must not begin inside another mark"
        if wrong:
            raise ValueError(f"template can't be read back: {wrong}")


#: After the escape character at the start of a role: the role only resembles a title.
FOREIGN = "e"


def literal(text: str) -> str:
    """A pattern that matches just the text."""
    return "".join(c if c.isalnum() or ord(c) > 127 or c in "\n\t\r" else "\\" + c for c in text)


def escape(text: Column, template: Template) -> Column:
    for plain, written in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, template: Template) -> Column:
    for plain, written in reversed(template.escapes):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def title(role: Column, template: Template) -> Column:
    """The role as written: its title, or for a role without one the escaped role itself."""
    out = escape(role, template)
    for name, said in template.titles.items():
        out = F.when(role == name, F.lit(said)).otherwise(out)
    return out


def role_of(said: Column, template: Template) -> Column:
    out = unescape(said, template)
    for name, written in template.titles.items():
        out = F.when(said == written, F.lit(name)).otherwise(out)
    return out


def first_bad_turn(roles: Column, template: Template) -> Column:
    """Position of the first turn that the machine refuses, the number of turns if it ends in a
    state that isn't final, else null."""
    step = lambda state, role: _any((state == F.lit(s)) & role.isin(*after) for s, after in template.follows.items())
    walked = F.aggregate(
        roles,
        F.struct(F.lit("").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad")),
        lambda acc, role: F.struct(
            role.alias("state"),
            (acc["i"] + 1).alias("i"),
            F.coalesce(acc["bad"], F.when(~step(acc["state"], role), acc["i"])).alias("bad"),
        ),
    )
    return let(walked, lambda w: F.coalesce(w["bad"], F.when(~w["state"].isin(*template.final), w["i"])))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conv_id: n_turns, segments array<struct<text, loss>>, formatted, bad_turn.

    Turns go by (turn, role, text), nulls first; a null text or role counts as empty, repeated
    rows are turns of their own, rows with a null conv_id are one conversation. A very long conversation
    is one row, whose turns one task holds. An empty table has no conversations; other columns play no part. Every conversation is formatted; bad_turn says
    where the machine refused it (null: valid). A foreign role that reads like a title, such as
    "Assistant", is marked and stays apart from the role it resembles.
    """
    template = template or Template()
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    # The order is that of the texts themselves, so they are escaped after it.
    gathered = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    mark = F.lit(template.escapes[0][0] + FOREIGN)

    def said(role: Column) -> Column:
        written = title(role, template)
        return F.when(role.isin(*template.titles.values()), F.concat(mark, written)).otherwise(written)

    pieces = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.open), said(t["role"]), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.learned).alias("loss")),
                F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return gathered.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        pieces.alias("segments"),
        first_bad_turn(F.transform("ts", lambda t: t["role"]), template).alias("bad_turn"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> from what format_chats wrote with the same template."""
    template = template or Template()
    cut = F.split(formatted, literal(template.close))
    parts = F.slice(cut, F.lit(1), F.size(cut) - 1)
    mark = template.escapes[0][0] + FOREIGN

    def turn(part: Column) -> Column:
        rest = F.substring(part, len(template.open) + 1, 1 << 30)
        at = F.instr(rest, template.after_role)
        said = F.substring(rest, F.lit(1), at - 1)
        foreign = said.startswith(mark)
        role = F.when(foreign, unescape(F.substring(said, len(mark) + 1, 1 << 30), template)).otherwise(role_of(said, template))
        text = unescape(F.substring(rest, at + len(template.after_role), F.lit(1 << 30)), template)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(parts, turn)


def learned_text(segments: Column, template: Template | None = None) -> Column:
    """The un-escaped text of the segments under the loss mask, in order, with nothing between."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
