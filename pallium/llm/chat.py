"""Chat formatting with loss flags (operator 4, DataFrame functions only).

A declarative template names the control strings, the roles under the loss and
the allowed turn orders. A finite-state machine, its state the last role, runs
over each conversation's ordered turns and accepts or rejects the order; every
turn is emitted as text segments, each with a loss flag. Control strings inside
texts are escaped reversibly, so the formatted string can be read back.

One row holds one conversation, as the formatted string is one value; nothing
larger than a conversation is gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """A turn is ``open`` + role + ``after_role`` + text + ``close``. ``mark``
    begins every control string; in texts it is written ``escaped_mark``, and
    ``escape`` is doubled."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    mark: str = "<|"
    escaped_mark: str = "<\\|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state (the last role) and the roles that may follow it
    order: tuple[tuple[str, tuple[str, ...]], ...] = (
        (START, ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )


CHATML = Template()


def escaped(text: Column, t: Template) -> Column:
    doubled = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    return F.replace(doubled, F.lit(t.mark), F.lit(t.escaped_mark))


def unescaped(text: Column, t: Template) -> Column:
    """The inverse: a mark with a single escape inside can only be an escaped
    one, as escapes of the text itself come in pairs."""
    marked = F.replace(text, F.lit(t.escaped_mark), F.lit(t.mark))
    return F.replace(marked, F.lit(t.escape * 2), F.lit(t.escape))


def accepts(turns: Column, t: Template) -> Column:
    """The machine's verdict on an ordered array of turns."""
    moves = F.array(*[F.lit(f"{state} {role}") for state, roles in t.order for role in roles])

    def step(state: Column, turn: Column) -> Column:
        move = F.concat_ws(" ", state, turn["role"])
        return F.when(F.array_contains(moves, move), turn["role"]).otherwise(F.lit(""))

    return F.aggregate(turns, F.lit(START), step) != ""


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id``, ``valid`` (the machine accepts the order of turns),
    ``segments`` (array of text and loss flag) and ``formatted``.

    Turns are ordered by turn, then role, then text, so that ties and repeated
    rows have one order; a null turn comes first. Null texts and roles count as
    empty, each row with a null conv_id is a conversation of its own, and
    conversations that the machine rejects are formatted all the same. Roles are URL-encoded in
    the output, which leaves plain names as they are. Only conv_id, turn, role
    and text are read.
    """
    t = template
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    # Rows without an id are no group, which might be of any size.
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = rows.select("conv_id", own.alias("own"), turn.alias("t")).groupBy("conv_id", "own").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            segment(F.concat(F.lit(t.open), F.url_encode(x["role"]), F.lit(t.after_role)), F.lit(False)),
            segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
            segment(F.lit(t.close), F.lit(False)),
        )

    made = grouped.select("conv_id", accepts(F.col("turns"), t).alias("valid"),
                          F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted string as an array of role and text."""
    t = template
    parts = F.split(formatted, re.escape(t.open))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, t.after_role, 1)
        head = F.length(role) + len(t.after_role)
        text = F.substring(part, head + 1, F.length(part) - head - len(t.close))
        return F.struct(F.url_decode(role).alias("role"), unescaped(text, t).alias("text"))

    return F.transform(F.slice(parts, 2, F.size(parts)), turn)


def read_loss(segments: Column, template: Template = CHATML) -> Column:
    """The text under the loss mask, unescaped."""
    texts = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    return F.array_join(texts, "")


def digest(made: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests read back from :func:`format_chats`'s output."""
    read = made.select("conv_id", "valid", "formatted", read_turns(F.col("formatted"), template).alias("turns"),
                       read_loss(F.col("segments"), template).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
