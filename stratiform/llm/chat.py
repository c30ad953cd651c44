"""Chat formatting: every participant's own view of a dialogue, with masks over what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = 64


def _plain(column: Column) -> Column:
    """Text that cannot open or close a turn."""
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, turns_per_part: int = TURNS) -> DataFrame:
    """One row per dialogue, participant and part: ``conv_id, speaker, part, n_turns, text, spans``.

    ``text`` renders the turns with the speaker as assistant and everyone else as a named user; ``spans`` are the
    character ranges (start, stop) of the speaker's own content and its end mark, the only stretches to learn from.
    A part holds the turns from ``part * turns_per_part`` on; the parts in order make up the dialogue, so that a
    dialogue of any length is never gathered in one row. Offsets count from the start of the part.

    Turns are ordered by (turn, role, text), nulls first; rows repeated in full count once. A null text is empty, a
    null role speaks as ``unknown`` and has no view of its own, a null turn forms part null, and null is a dialogue of its own.
    Marks inside texts and names are defused. Other columns of the input are not read.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    part = F.floor(F.col("turn") / turns_per_part).cast("long").alias("part")
    said = F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("said")
    parts = turns.groupBy("conv_id", part).agg(said)
    speakers = turns.where("role is not null").select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker"))
    rows = parts.join(speakers.distinct(), F.col("conv_id").eqNullSafe(F.col("_conv")))

    def rendered(turn: Column) -> Column:
        own = turn["role"].eqNullSafe(F.col("speaker"))
        named = F.concat(F.lit(f"{START}user name="), _plain(F.coalesce(turn["role"], F.lit("unknown"))), F.lit("\n"))
        return F.struct(
            own.alias("own"),
            F.when(own, F.lit(f"{START}assistant\n")).otherwise(named).alias("head"),
            F.concat(_plain(turn["text"]), F.lit(END)).alias("body"),
        )

    rows = rows.withColumn("_turns", F.transform("said", rendered))
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    span = F.array().cast("array<struct<start:int,stop:int>>")

    def add(held: Column, turn: Column) -> Column:
        start = held["at"] + F.length(turn["head"])
        stop = start + F.length(turn["body"])
        own = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(
            (stop + 1).alias("at"), F.when(turn["own"], F.concat(held["spans"], own)).otherwise(held["spans"]).alias("spans")
        )

    start = F.struct(F.lit(0).alias("at"), span.alias("spans"))
    spans = F.aggregate("_turns", start, add, lambda held: held["spans"])
    n_turns = F.size("said").cast("long").alias("n_turns")
    return rows.select("conv_id", "speaker", "part", n_turns, text.alias("text"), spans.alias("spans"))
