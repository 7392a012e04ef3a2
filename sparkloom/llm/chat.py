"""Chat formatting with DataFrame functions only.

A template is data: the control strings around a turn, the roles that carry
loss, and a finite-state machine over roles. Turns of a conversation are ordered,
the machine walks over them and says where (if anywhere) the order breaks, and the
turns become text segments, each with its loss flag; the formatted text is the
segments in a row. Inside role and text every character that starts a control string is
escaped, so control strings occur in the output only as marks, and unescaping
gives the text back exactly.

Nulls: a null text or role is empty; a null turn comes first; null conversation ids form
one conversation. Equal turns are ordered by role and text; repeated rows stay. A
conversation that the machine rejects is formatted all the same, with ``valid`` false
and the place in ``bad_turn``. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    before: str = "<|turn|>"
    between: str = "<|text|>"
    after: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("asked", "answered")
    escape: str = "\\"

    @property
    def leads(self) -> list[str]:
        return sorted({c[0] for c in (self.before, self.between, self.after)})


def escaped(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape + "0"))
    for i, c in enumerate(t.leads):
        out = F.replace(out, F.lit(c), F.lit(f"{t.escape}{i + 1}"))
    return out


def unescaped(text: Column, t: Template) -> Column:
    out = text
    for i, c in enumerate(t.leads):
        out = F.replace(out, F.lit(f"{t.escape}{i + 1}"), F.lit(c))
    return F.replace(out, F.lit(t.escape + "0"), F.lit(t.escape))


def walk(turns: Column, t: Template) -> Column:
    """The machine's verdict: struct(state, bad), bad being the place of the first turn out of order, else null."""
    moves = F.create_map(*[F.lit(x) for state, by in t.moves.items() for role, to in by.items() for x in (f"{state}\n{role}", to)])

    def step(held: Column, turn: Column) -> Column:
        to = moves[F.concat(held["state"], F.lit("\n"), turn["role"])]
        stopped = held["bad"].isNotNull() | to.isNull()
        return F.struct(F.when(stopped, held["state"]).otherwise(to).alias("state"), F.when(held["bad"].isNotNull(), held["bad"]).when(to.isNull(), held["n"]).alias("bad"), (held["n"] + 1).alias("n"))

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    return F.aggregate(turns, begin, step)


def chat_format(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, valid, bad_turn, segments (text, loss), formatted."""
    t = template or Template()
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gathered = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(t.before), escaped(x["role"], t), F.lit(t.between))
        return F.array(part(head, F.lit(False)), part(escaped(x["text"], t), x["role"].isin(*t.loss_roles)), part(F.lit(t.after), F.lit(False)))

    out = gathered.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), walk(F.col("turns"), t).alias("end"))
    return out.select(
        "conv_id",
        (F.col("end.bad").isNull() & F.col("end.state").isin(*t.accepting)).alias("valid"),
        F.col("end.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Turns from the formatted text and the text under the loss mask, unescaped: adds turns and loss_text."""
    t = template or Template()
    parts = F.split(F.col("formatted"), re.escape(t.after))
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        body = F.substring(x, len(t.before) + 1, 2147483647)
        return F.struct(unescaped(F.substring_index(body, t.between, 1), t).alias("role"), unescaped(F.substring_index(body, t.between, -1), t).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t))
    return formatted.withColumns({"turns": F.transform(parts, turn), "loss_text": F.array_join(loss, "")})


def digests(read: DataFrame) -> DataFrame:
    """The contract's columns from ``read_back``."""
    listed = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
