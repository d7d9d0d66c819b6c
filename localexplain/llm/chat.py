"""Chat formatting: a state machine over roles, segments with loss flags, and the way back.

Only DataFrame functions. A conversation becomes one string, so its rows meet in one row; that is the contract's output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Declares markers, which roles may follow which, and the roles whose text is trained on.

    Markers must start with "<|" and hold no newline but at their end: texts are escaped so that they never hold "<|".
    """

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    newline_in_role: str = "<|nl|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )


CHATML = Template()


def escape(text: Column) -> Column:
    """Puts one more backslash between "<" and "|", so that "<|" never occurs; unescape() takes it away again."""
    return F.regexp_replace(text, r"<(\\*\|)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*\|)", r"<$1")


def _path(roles: Column, template: Template) -> Column:
    """Runs the machine: the index of the first turn that may not stand where it stands (from 0), -1 if none."""
    edges = [f"{a}\n{b}" for a, to in template.follows.items() for b in to]
    allowed = F.array(*map(F.lit, edges))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(s: Column, role: Column) -> Column:
        fits = F.array_contains(allowed, F.concat(s.state, F.lit("\n"), role))
        return F.struct(
            role.alias("state"),
            (s.at + 1).alias("at"),
            F.when((s.bad >= 0) | fits, s.bad).otherwise(s["at"]).alias("bad"),
        )

    return F.aggregate(roles, start, step, lambda s: s.bad)


def format_chat(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, first_bad_turn (-1: valid order), segments array<struct<text, loss>>, formatted.

    Turns are ordered by turn, then role and text (ties; equal rows are kept, all of them); null turns first. A null
    role or text is the empty string. A conversation in an order that the machine refuses is formatted all the same and
    marked. Extra columns are ignored. An empty table gives no rows.
    """
    row = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def parts(r: Column) -> Column:
        role = F.replace(escape(r["role"]), F.lit("\n"), F.lit(template.newline_in_role))
        head = F.concat(F.lit(template.turn_start), role, F.lit(template.role_end))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(r["text"]).alias("text"), r["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.turn_end).alias("text"), F.lit(False).alias("loss")),
        )

    segments = F.flatten(F.transform("rows", parts))
    return (
        grouped.select(
            "conv_id",
            F.size("rows").cast("long").alias("n_turns"),
            _path(F.transform("rows", lambda r: r["role"]), template).alias("first_bad_turn"),
            segments.alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def parse_chat(formatted: Column, template: Template = CHATML) -> Column:
    """The turns in a formatted text, as array<struct<role, text>> without escapes."""
    pieces = F.split(formatted, r"\Q" + template.turn_end + r"\E")
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.turn_start) + 1))
        role = F.substring_index(body, template.role_end, 1)
        text = F.substr(body, F.length(role) + len(template.role_end) + 1)
        return F.struct(
            unescape(F.replace(role, F.lit(template.newline_in_role), F.lit("\n"))).alias("role"),
            unescape(text).alias("text"),
        )

    return F.transform(whole, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, without escapes, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """The contract's digest columns, read back from format_chat()'s output, then first_bad_turn as the machine found it.

    One row for each row of chats; an empty table gives none. Texts and roles come back as they were, null as empty.
    """
    turns = parse_chat(F.col("formatted"), template)
    lines = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        chats.withColumn("parsed", turns)
        .withColumn("under_loss", loss_text(F.col("segments")))
        .select(
            "conv_id",
            F.size("parsed").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("under_loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("under_loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "first_bad_turn",
        )
    )
