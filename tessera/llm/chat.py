"""Chat formatting with rotated perspectives, in DataFrame functions only.

Every participant of a conversation (a distinct role, but for ``system``) is once the
assistant: their turns become assistant turns, which are trained on, and everyone
else's become turns of a user with a name.  Turns keep a row each, with the place of
their segment in the rendered text, so a conversation of any length is rendered without
collecting it: turns are dealt over tasks by ranges of their order and numbered, and
offsets come from a prefix sum in two steps, over blocks of numbers and over the turns of
one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: Rows in a block, a power of two; a block's rows of one conversation meet in one task.
BLOCK = 1 << 16
#: Letters of a text by which turns of one number and role are dealt over tasks.
SPLIT = 128
SYSTEM = "system"
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"


def _clean(text: Column) -> Column:
    """The text with control marks broken up, so that a turn cannot forge another."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")


def _head(name: Column, as_assistant: Column) -> Column:
    """What opens a segment: the assistant, the system, or a user with a name."""
    user = F.concat(F.lit("user name="), F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"))
    return F.concat(F.lit(_OPEN), F.when(as_assistant, "assistant").when(name == SYSTEM, SYSTEM).otherwise(user), F.lit("\n"))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, seq, segment, a, b, mask_a, mask_b): a row per turn and participant.

    The segments of one conversation and perspective, in the order of ``seq``, are its
    rendered text; a to b is the segment's place there, in code points.  mask_a to
    mask_b, inside it, is what the model learns (the text and end mark of the
    perspective's own turns), an empty range elsewhere.  Turns are ordered by number (null last),
    then role, then text; repeated rows are turns of their own.  A null role is a participant
    named ``unknown``, a null text is empty, and rows without a conv_id form one
    conversation.  A conversation of system turns only has no perspective.
    """
    own = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        _clean(F.col("text")).alias("body"),
    )
    # Equal rows count once here, with their number, and come apart at the end.
    own = own.groupBy("conv_id", "turn", "role", "body").agg(F.count("*").alias("copies"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role")]
    dealt = own.repartitionByRange(*order, F.substring("body", 1, SPLIT)).sortWithinPartitions(*order, "body")
    own = materialize(dealt.withColumn("nth", F.monotonically_increasing_id()), "turns")
    people = materialize(own.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct(), "people")
    # Only lengths are repeated for each participant, and exchanged; the texts follow at the end, by row.
    rows = own.select("conv_id", "nth", F.expr(f"nth div {BLOCK}").alias("block"), "role", F.char_length("body").alias("chars"), "copies")
    rows = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("size", (F.char_length(_head(F.col("role"), F.col("role") == F.col("perspective"))) + F.col("chars") + F.lit(len(_CLOSE))).cast("bigint"))
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("length"), F.sum("copies").alias("turns"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(
        F.col("conv_id").alias("of"),
        F.col("perspective").alias("whose"),
        F.col("block").alias("held"),
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turn_base"),
    )
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    placed = placed.withColumn("nth_row", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("perspective") == F.col("whose")) & (F.col("block") == F.col("held"))
    placed = placed.join(bases, same).select("nth", "perspective", "size", "base", "at", "turn_base", "nth_row")
    placed = own.join(placed, "nth").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    placed = placed.withColumn("mine", F.col("role") == F.col("perspective")).withColumn("head", _head(F.col("role"), F.col("mine")))
    start = F.col("base") + F.col("at") + F.col("copy") * F.col("size")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("turn_base") + F.col("nth_row") + F.col("copy")).alias("seq"),
        F.concat("head", "body", F.lit(_CLOSE)).alias("segment"),
        start.alias("a"),
        (start + F.col("size")).alias("b"),
        F.when(F.col("mine"), start + F.char_length("head")).otherwise(start).alias("mask_a"),
        F.when(F.col("mine"), start + F.col("size") - 1).otherwise(start).alias("mask_b"),
    )
