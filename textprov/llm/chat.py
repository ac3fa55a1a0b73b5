"""Chat formatting: every dialogue once from the view of each participant.

In the view of one speaker, that speaker's turns are the assistant's, all others are named users, and system turns stay
system turns. The training mask covers what the assistant says and its end mark. Dialogues are cut into chunks of
``chunk_turns`` turns (a view's text is its chunks one after another), so that no dialogue is gathered in one task.

Everything is DataFrame code. Defined cases: a null speaker is called ``unknown``, a null text is empty, null turns come
first, and rows with a null id are one dialogue. Turns of one number are ordered by speaker and text; repeated rows are
repeated turns. A dialogue of system turns only has no participant and no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_TURNS = 1024
SYSTEM = ("system",)
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers that are summed up together before a dialogue's own running count.
SPAN_BITS = 12


def placed(turns: DataFrame) -> DataFrame:
    """``place``: the number of the turn in its dialogue from 0; counts per number are added up in two steps."""
    counts = turns.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("c")).withColumn("span", F.shiftright("turn", SPAN_BITS))
    spans = counts.groupBy("conv", "span").agg(F.sum("c").alias("total"))
    upto = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("lower", F.coalesce(F.sum("total").over(upto), F.lit(0)))
    inner = Window.partitionBy("conv", "span").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inner", F.coalesce(F.sum("c").over(inner), F.lit(0)))
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & F.col("a.span").eqNullSafe(F.col("b.span"))
    counts = counts.alias("a").join(spans.alias("b"), same).select("a.conv", "a.turn", (F.col("lower") + F.col("inner")).alias("before"))
    tie = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("speaker", "text")) - 1
    ranked = turns.withColumn("tie", tie)
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & F.col("a.turn").eqNullSafe(F.col("b.turn"))
    return ranked.alias("a").join(counts.alias("b"), same).select("a.conv", "speaker", "text", (F.col("before") + F.col("tie")).alias("place"))


def perspectives(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple[str, ...] = SYSTEM, chunk_turns: int = CHUNK_TURNS,
) -> DataFrame:
    """conv_id, speaker, chunk, messages (role, name, content, trained), text, mask.

    ``mask`` is a run-length code over the characters of ``text``: (length, trained) pairs.
    """
    turns = conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(speaker), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chunks = placed(turns).groupBy("conv", F.floor(F.col("place") / chunk_turns).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    views = turns.filter(~F.col("speaker").isin(*system)).select("conv", F.col("speaker").alias("view")).distinct()
    rows = chunks.alias("c").join(views.alias("v"), F.col("c.conv").eqNullSafe(F.col("v.conv"))).select(F.col("c.conv").alias("conv_id"), "view", "chunk", "turns")

    def message(t):
        own, fixed = t["speaker"] == F.col("view"), t["speaker"].isin(*system)
        role = F.when(own, "assistant").when(fixed, "system").otherwise("user")
        return F.struct(role.alias("role"), F.when(~own & ~fixed, t["speaker"]).alias("name"), t["text"].alias("content"), own.alias("trained"))

    def pieces(m):
        head = F.concat(F.lit(START), m["role"], F.when(m["name"].isNotNull(), F.concat(F.lit(" name="), m["name"])).otherwise(""), F.lit("\n"))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("trained")), F.struct(F.concat(m["content"], F.lit(END)).alias("text"), m["trained"].alias("trained")))

    rows = rows.withColumn("messages", F.transform("turns", message)).withColumn("pieces", F.flatten(F.transform("messages", pieces)))
    return rows.select(
        "conv_id", F.col("view").alias("speaker"), "chunk", "messages", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        F.transform("pieces", lambda p: F.struct(F.char_length(p["text"]).alias("length"), p["trained"].alias("trained"))).alias("mask"),
    )
