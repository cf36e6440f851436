"""Chat formatting by perspective rotation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import prefix_sums

INSTRUCTION = "system"
UNNAMED = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame) -> DataFrame:
    """Every conversation once from the side of each participant, a row for each turn of each side.

    A conversation's participants are the roles in it but the instruction role. Seen from one of them, its own turns are
    those of the assistant, the others' are users' with their role as name, instructions stay instructions. A row has
    conv_id, perspective, turn, speaker, chat_role (assistant, user or system), rendered (header, text, end mark), start
    and stop (code points before and after it in this side's rendering), trained (the turn is the assistant's), and
    mask_start and mask_stop: the code points of the rendering that are trained on, text and end mark but not the header
    (equal where there are none). Rendered in order of turn, a side's rows are its training text.

    A conversation stays in rows, dealt by range with distributed prefix sums, so one with any number of turns meets in
    no task. The sums are over lengths only; texts are shuffled once, to meet their offsets. Participants are distinct
    roles, combined before they are shuffled.

    Nulls: a null role is the participant 'unknown', a null text is empty, null ids are one conversation, null turns come
    first. Equal turns of a conversation are ordered by role and the SHA-256 of the text. A conversation of instructions only
    has no sides and no rows. Empty table: no rows. Other columns are not looked at.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("tie", F.sha2(F.col("text").cast("binary"), 256))
    # One key without nulls, so that grouping and joining by it share one exchange of the texts.
    name = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("conv_id", "turn", "tie")), F.col("speaker"))
    said = said.withColumn("_key", name)
    sides = said.filter(F.col("speaker") != INSTRUCTION).groupBy("conv_id", "speaker").agg(F.lit(1).alias("_one"))
    sides = sides.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective"))
    # Every turn once for each participant: that is the result's size, and no pairs of turns are made.
    lengths = said.select("conv_id", "turn", "speaker", "tie", "_key", F.length("text").cast("long").alias("_chars")).join(sides, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    chat_role = F.when(F.col("speaker") == INSTRUCTION, F.lit("system")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    header = F.concat(F.lit(OPEN), chat_role, F.when(chat_role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit("")), F.lit("\n"))
    sized = lengths.withColumn("_header", F.length(header).cast("long")).withColumn("_length", F.col("_header") + F.col("_chars") + len(CLOSE))
    placed = prefix_sums(sized, ["conv_id", "perspective", "turn", "speaker", "tie"], {"_start": "_length"}, by=["conv_id", "perspective"])
    # Equal rows follow one another and have one length, so the first one's offset tells all.
    starts = placed.groupBy("_key", "perspective", "_header", "_length").agg(F.min("_start").alias("_start"))
    once = said.groupBy("_key").agg(*(F.first(c).alias(c) for c in ("conv_id", "turn", "speaker", "text")), F.count("*").alias("_copies"))
    met = once.join(starts, "_key")
    each = met.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    start = F.col("_start") + F.col("_copy") * F.col("_length")
    trained = chat_role == "assistant"
    return each.select(
        "conv_id", "perspective", "turn", "speaker", chat_role.alias("chat_role"), F.concat(header, F.col("text"), F.lit(CLOSE)).alias("rendered"), start.alias("start"),
        (start + F.col("_length")).alias("stop"), trained.alias("trained"), F.when(trained, start + F.col("_header")).otherwise(start + F.col("_length")).alias("mask_start"), (start + F.col("_length")).alias("mask_stop"),
    )
