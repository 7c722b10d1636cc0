"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask covers what the speaker says. A row
of the result is a message as one participant sees it, so a conversation of any length is
never gathered in one place: participants are found by an aggregate that is combined before
it moves, and joined to the turns. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def apart(text: Column) -> Column:
    """The text with marks that open or close a message taken apart."""
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    return text


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, perspective, turn, role, name, rendered, mask_start, mask_stop for each message and participant.

    ``rendered`` opens with the role (and the name of a user), holds the whole text and
    closes with an end mark; texts put together in order of ``turn`` are the dialogue. Characters
    [mask_start, mask_stop) of it are trained on: text and end mark of the perspective's
    own messages, nothing (0, 0) of others. Narrators keep their role in every rendering and
    have no perspective; a conversation of narrators alone gives no rows.

    A null speaker is a participant without a name: null as a perspective, and a user without
    ``name=`` in a rendering. Breaks in a speaker's name are spaces in a rendering. Marks that
    open or close a message are taken apart where they stand in a text or a name (``<|`` becomes ``< |``),
    so that neither can end its message or open another. Null text is empty, null conversation ids are one
    conversation. Turns with equal numbers are in the order of speaker (null first) and text,
    which ``messages`` puts them in; repeated rows all come back. Other columns are left out. An
    empty table gives no rows.
    """
    text = apart(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    lines = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(speaker_col).cast("string").alias("speaker"), text.alias("text"))
    narrates = F.coalesce(F.col("speaker").isin(*narrators), F.lit(False))
    seats = lines.where(~narrates).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = lines.join(seats, lines["conv_id"].eqNullSafe(seats["_conv"]))
    own = ~narrates & F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(narrates, F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(role == "user", apart(F.regexp_replace("speaker", r"[\r\n]+", " ")))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    tail = CLOSE + "\n"
    zero = F.lit(0).cast("long")
    return seen.select(
        "conv_id",
        "perspective",
        "turn",
        role.alias("role"),
        name.alias("name"),
        F.concat(head, F.col("text"), F.lit(tail)).alias("rendered"),
        F.when(own, F.length(head).cast("long")).otherwise(zero).alias("mask_start"),
        F.when(own, (F.length(head) + F.length("text") + len(tail) - 1).cast("long")).otherwise(zero).alias("mask_stop"),
    )


def messages(rotated: DataFrame) -> DataFrame:
    """A rotation's messages in the order of each dialogue as one participant sees it.

    A sort over all rows, dealt out by range, so a long dialogue is never one task's alone;
    written as it is, each file holds stretches of dialogues in order.
    """
    return rotated.orderBy("conv_id", "perspective", "turn", F.col("name").asc_nulls_first(), "rendered")


ROTATE_SQL = """
WITH lines AS (
  SELECT conv_id, turn, role AS speaker, replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text FROM conversations),
seats AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM lines WHERE speaker IS DISTINCT FROM 'system'),
seen AS (
  SELECT conv_id, perspective, turn, text,
    CASE WHEN speaker = 'system' THEN speaker WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker IS DISTINCT FROM 'system' AND speaker IS DISTINCT FROM perspective 
      THEN replace(replace(regexp_replace(speaker, '[\\r\\n]+', ' ', 'g'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') END AS name
  FROM lines JOIN seats ON conv_id IS NOT DISTINCT FROM conv),
heads AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM seen)
SELECT conv_id, perspective, turn, role, name, head || text || '<|im_end|>' || chr(10) AS rendered,
  CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS mask_start,
  CASE WHEN role = 'assistant' THEN length(head) + length(text) + 10 ELSE 0 END AS mask_stop
FROM heads
"""
