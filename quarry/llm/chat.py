"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation are put in order, checked by the machine and laid
out as text segments, each with a flag that says whether the loss counts
it.  DataFrame functions only.

Control strings inside texts are escaped reversibly: a run of bars after
``<`` gets one bar more, so ``<|`` followed by anything but a bar can only
be a mark of the template.  (Line breaks in roles become ``<|n|>``, as a
role ends at the first one.)

Turns are ordered by turn number (null first), then role, then text, so
ties and repeated rows have one order; every row is a turn.  Null roles and
texts are empty; rows with a null conversation id form one conversation.
A conversation that the machine rejects is formatted like any other and
has ``valid`` false.  Other columns are not looked at, and an empty table has no conversations.  One conversation is
one output text, so it is built by one task whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import quoted


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles under the loss, and the machine: state -> role -> next state."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    accepting: tuple[str, ...] = ("asked", "answered")
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "begin": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })


def escape(text: Column) -> Column:
    """One more bar in every ``<|`` run."""
    return F.regexp_replace(text, r"<(\|+)", r"<$1|")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def final_state(roles: Column, template: Template) -> Column:
    """State of the machine after all roles; ``rejected`` once a move is missing."""
    pairs = [x for state, moves in template.moves.items() for role, to in moves.items()
             for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    table = F.create_map(*pairs)
    return F.aggregate(roles, F.lit(template.initial),
                       lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), role)),
                                                      F.lit("rejected")))


def format_conversations(turns: DataFrame, template: Template = Template(), by: tuple[str, ...] = ("conv_id",),
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its key, ``segments`` array<struct<text, loss>>, ``formatted``, ``valid``."""
    rows = turns.select(*[quoted(c) for c in by],
                        F.struct(quoted(turn).alias("turn"),
                                 F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
                                 F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text")).alias("__turn"))
    talks = rows.groupBy(*[quoted(c) for c in by]).agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))

    def segments(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template.start), _escape_role(t["role"]), F.lit("\n")).alias("text"),
                     F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.end + "\n").alias("text"), F.lit(False).alias("loss")))

    laid = talks.select(*[quoted(c) for c in by],
                        final_state(F.transform("__turns", lambda t: t["role"]), template)
                        .isin(*template.accepting).alias("valid"),
                        F.flatten(F.transform("__turns", segments)).alias("segments"))
    return laid.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    quote = "\\Q" + template.start + "\\E"
    pieces = F.slice(F.split(formatted, quote, -1), 2, 2_000_000_000)
    tail = len(template.end) + 1

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 1 - tail)
        return F.struct(_unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
