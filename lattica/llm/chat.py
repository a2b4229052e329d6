"""Chat formatting: every dialogue from the perspective of each of its participants, in DataFrame operations only.

For each participant the dialogue is rendered with that speaker as the assistant and the others as named users; turns of
context roles (the system prompt) stay what they are and take no perspective. The mask holds the code point spans of the
assistant's words, which are those to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _harmless(text: Column) -> Column:
    """``text`` in which no control token can be read: a blank goes between its first characters."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def rotate_perspectives(turns: DataFrame, *, context_roles: tuple[str, ...] = ("system",), segment_turns: int = 1024) -> DataFrame:
    """One row for each conv_id, participant (perspective) and segment: text, mask_spans, n_turns, n_assistant, n_masked.

    Turns go by (turn, role, text). A null role is a participant of its own, shown by the name "unknown"; null texts are
    empty; a null turn counts as the first. Repeated rows are rendered as often as they occur. Control tokens within
    texts and names, and line feeds within names, are made harmless. A dialogue of context roles alone has no
    participant and gives no row; an empty table gives an empty result.

    A dialogue's rendering is cut into rows by ``segment_turns`` turn numbers, so that a row stays bounded where turn
    numbers differ: the texts of its segments in a row are the whole rendering, whatever the cut, and every span counts
    from the start of its row.
    """
    role = F.replace(_harmless(F.col("role")), F.lit("\n"), F.lit(" "))
    rows = turns.select("conv_id", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / segment_turns).alias("segment"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), role.alias("role"), _harmless(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    context = F.coalesce(F.col("role").isin(*context_roles), F.lit(False))
    speakers = rows.filter(~context).groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("role"))).alias("participants"))
    dialogues = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    seen = dialogues.join(speakers, dialogues["conv_id"].eqNullSafe(speakers["conv_id"])).drop(speakers["conv_id"])
    seen = seen.select("conv_id", "segment", "turns", F.explode("participants.role").alias("perspective"))

    def head(turn: Column) -> Column:
        label = F.when(turn["role"].eqNullSafe(F.col("perspective")), F.lit("assistant")).when(turn["role"].isin(*context_roles), turn["role"])
        label = label.otherwise(F.concat(F.lit("user name="), F.coalesce(turn["role"], F.lit("unknown"))))
        return F.concat(F.lit(OPEN), label, F.lit("\n"))

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), t["role"].eqNullSafe(F.col("perspective")).alias("own")))
    shown = seen.withColumn("parts", parts)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["head"])
        end = begin + F.length(part["text"])
        span = F.when(part["own"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + len(CLOSE)).alias("at"), F.concat(state["spans"], span).alias("spans"))

    own = F.filter("parts", lambda p: p["own"])
    return shown.select(
        "conv_id",
        "perspective",
        F.col("segment").cast("long").alias("segment"),
        F.size("parts").cast("long").alias("n_turns"),
        F.size(own).cast("long").alias("n_assistant"),
        F.aggregate(own, F.lit(0), lambda n, p: n + F.length(p["text"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "").alias("text"),
        F.array_join(F.aggregate("parts", start, step)["spans"], ",").alias("mask_spans"),
    )
