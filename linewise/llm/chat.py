"""Chat formatting by a declarative template, with DataFrame functions only.

A template names the marks around a turn, the roles whose texts bear loss, and the state
machine of turn order: (state, role) -> next state. The operator walks the machine over the
roles of a conversation, and emits text segments with a loss flag each; only the text of a
loss role bears loss, never its marks. Texts and roles cannot forge marks: the first
character of a control string inside a text is written as %XX, and % itself as %25.

A conversation is one training record and one row of the result, as a document is; escaping
and all per-turn text work run before turns meet.

Defined results: null text and null role are empty; turns are ordered by turn (null first), then
role, then text, so repeated turns stay; a conversation the machine rejects is formatted all the same,
with valid false and the number of the first bad turn; null conv_id is one conversation; no rows
give no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, REJECT = "start", "reject"


@dataclass(frozen=True)
class ChatTemplate:
    """before_role + role + after_role + text + after_text for every turn."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        (START, "system"): "system", (START, "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    })
    final_states: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = (self.before_role, self.after_text.strip("\n"))
        if any(mark not in self.controls for mark in marks) or any("%" in c or not c for c in self.controls):
            raise ValueError("every mark must be a control string without %")


def _code(character: str) -> str:
    return "".join(f"%{byte:02X}" for byte in character.encode())


def escape(text: Column, template: ChatTemplate) -> Column:
    """Text in which no control string occurs."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("%"), F.lit("%25"))
    return reduce(lambda c, control: F.replace(c, F.lit(control), F.lit(_code(control[0]) + control[1:])), template.controls, out)


def unescape(text: Column, template: ChatTemplate) -> Column:
    firsts = sorted({control[0] for control in template.controls})
    out = reduce(lambda c, first: F.replace(c, F.lit(_code(first)), F.lit(first)), firsts, text)
    return F.replace(out, F.lit("%25"), F.lit("%"))


def escape_role(role: Column, template: ChatTemplate) -> Column:
    """A role must not hold the mark that ends it either."""
    return F.replace(escape(role, template), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column, template: ChatTemplate) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")), template)


def _walk(roles: Column, template: ChatTemplate) -> Column:
    """State after the last turn and number of the first rejected turn (null: none)."""
    table = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\n{role}", to)])
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("turn"), none.alias("bad"))

    def step(seen: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(seen["state"], F.lit("\n"), role)), F.lit(REJECT))
        bad = F.when(seen["bad"].isNull() & (to == REJECT), seen["turn"]).otherwise(seen["bad"])
        return F.struct(to.alias("state"), (seen["turn"] + 1).alias("turn"), bad.alias("bad"))

    return F.aggregate(roles, start, step)


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, valid, bad_turn, segments: array of (text, loss)."""
    marked = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("plain"),
            escape_role(F.col("role"), template).alias("name"), escape(F.col("text"), template).alias("text"),
        ).alias("turn"),
    )
    # the escaped text orders as the plain one does not, so the plain text is the tie-break and is dropped after the sort
    grouped = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(template.before_role), t["name"], F.lit(template.after_role)), no),
        segment(t["text"], t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.after_text), no),
    )))
    walked = grouped.select("conv_id", pieces.alias("segments"), _walk(F.transform("turns", lambda t: t["role"]), template).alias("walk"))
    return walked.select(
        "conv_id", (F.col("walk.bad").isNull() & F.col("walk.state").isin(*template.final_states)).alias("valid"),
        F.col("walk.bad").alias("bad_turn"), "segments",
    )


def formatted(chats: DataFrame) -> DataFrame:
    """conv_id, text: the whole formatted conversation; loss_texts: its segments that bear loss, in order."""
    return chats.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]).alias("loss_texts"),
    )


def read_back(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Array of (role, text) parsed from a formatted conversation."""
    quote = lambda s: "\\Q" + s + "\\E"
    turns = F.filter(F.split(text, quote(template.before_role)), lambda t: t != "")
    return F.transform(turns, lambda t: F.struct(
        unescape_role(F.substring_index(t, template.after_role, 1), template).alias("role"),
        unescape(
            F.substring(
                t, F.char_length(F.substring_index(t, template.after_role, 1)) + 1 + len(template.after_role),
                F.char_length(t) - F.char_length(F.substring_index(t, template.after_role, 1)) - len(template.after_role) - len(template.after_text),
            ), template,
        ).alias("text"),
    ))
