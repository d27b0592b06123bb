"""Chat formatting by relational means only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role are merged into a block with array functions; blocks are rendered and
concatenated. Everything is a Spark expression.

Template (one block)::

    <turn:ROLE>text<join>text of the next row with the same role</turn>\\n

Inside texts and roles ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles
also ``>`` becomes ``\\g``), so that no control string can occur in them and the
original rows are read back exactly. The loss mask lists the code-point spans
of the assistant's texts; marks and joints are outside it.

Defined results: a null text is empty; a null role is the empty role; rows that
share a turn number are ordered by role, then text; a null turn comes first;
repeated rows are kept; an empty table gives an empty table; other columns of
the input are ignored. One conversation becomes one row, since its formatted
text is one value; offsets within it are computed, and its spans read, in
linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import total, with_prefix

OPEN, CLOSE, JOIN = "<turn:", "</turn>\n", "<join>"


def escape(text: Column) -> Column:
    """Replace the two characters from which control strings are made."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape` (and of the role's escape)."""
    back = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(back, F.lit("\\b"), F.lit("\\"))


def format_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``loss_spans``.

    ``loss_spans`` holds ``struct<start, end>`` in code points of ``formatted``
    (end exclusive), one for each row of ``loss_role``.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.replace(escape(F.coalesce(F.col(role), F.lit(""))), F.lit(">"), F.lit("\\g")).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("_turn"),
    )
    sorted_turns = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    # Where blocks begin: the first turn, and each turn whose role differs from the one before it.
    same = lambda i: F.get(F.col("_turns"), i - 1)["role"] == F.get(F.col("_turns"), i)["role"]
    starts = sorted_turns.select(
        "_conv",
        "_turns",
        F.filter(
            F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | ~same(i)
        ).alias("_starts"),
    )
    blocks = starts.select(
        "_conv",
        F.transform(
            F.col("_starts"),
            lambda s, k: F.struct(
                F.get(F.col("_turns"), s)["role"].alias("role"),
                F.transform(
                    F.slice(
                        F.col("_turns"),
                        s + 1,
                        F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_turns")) - s,
                    ),
                    lambda t: t["text"],
                ).alias("texts"),
            ),
        ).alias("_blocks"),
    )
    # What is written between one text and the next: the joint, or a close and an open mark.
    pieces = blocks.select(
        "_conv",
        F.flatten(
            F.transform(
                F.col("_blocks"),
                lambda b: F.transform(
                    b["texts"],
                    lambda t, i: F.struct(
                        F.when(i == 0, F.concat(F.lit(OPEN), b["role"], F.lit(">")))
                        .otherwise(F.lit(JOIN))
                        .alias("before"),
                        t.alias("text"),
                        F.when(i == F.size(b["texts"]) - 1, F.lit(CLOSE)).otherwise(F.lit("")).alias("after"),
                        (b["role"] == F.lit(loss_role)).alias("loss"),
                    ),
                ),
            )
        ).alias("_pieces"),
    )
    lengths = F.transform(
        F.col("_pieces"),
        lambda p: (F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("long"),
    )
    sized = pieces.select("_conv", "_pieces", lengths.alias("_lengths"))
    sized = with_prefix(sized, "_at", "_lengths")
    spans = F.transform(
        F.col("_pieces"),
        lambda p, i: F.struct(
            (F.get(F.col("_at"), i) + F.length(p["before"])).alias("start"),
            (F.get(F.col("_at"), i) + F.length(p["before"]) + F.length(p["text"])).alias("end"),
            p["loss"].alias("loss"),
        ),
    )
    return sized.select(
        F.col("_conv").alias(conv),
        F.array_join(
            F.transform(F.col("_pieces"), lambda p: F.concat(p["before"], p["text"], p["after"])), ""
        ).alias("formatted"),
        F.transform(
            F.filter(spans, lambda s: s["loss"]),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
        ).alias("loss_spans"),
    )


def parse_conversations(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read formatted conversations back: ``conv``, ``turns`` (role, text), ``loss_texts``.

    ``turns`` are the original rows in order, unescaped; ``loss_texts`` are the
    texts under the mask.
    """
    parts = F.split(F.col("formatted"), "</turn>\\n", -1)
    turns = F.flatten(
        F.transform(
            F.slice(F.col("_parts"), F.lit(1), F.size("_parts") - 1),
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, ">") + 1), "<join>", -1),
                lambda t: F.struct(
                    unescape(F.substr(b, F.lit(len(OPEN) + 1), F.instr(b, ">") - len(OPEN) - 1)).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )
    cut = formatted.select(
        conv, "formatted", "loss_spans", parts.alias("_parts"), arrays.pieces(F.col("formatted")).alias("_pieces")
    )
    return cut.select(
        conv,
        "formatted",
        turns.alias("turns"),
        F.transform(
            F.col("loss_spans"), lambda s: unescape(arrays.between(F.col("_pieces"), s["start"], s["end"]))
        ).alias("loss_texts"),
    )


def digest(parsed: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of conversations that :func:`parse_conversations` read back."""
    whole = F.array_join(
        F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return parsed.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        total(F.transform(F.col("loss_texts"), lambda t: F.length(t).cast("long"))).alias("loss_chars"),
        F.sha2(F.array_join(F.col("loss_texts"), ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
