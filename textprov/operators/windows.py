"""Sliding windows over sentence tables. Long sequences are cut into overlapping chunks, see ``scale.sliding_rows``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.features import template_names
from .scale import CHUNK, sliding_rows, top_n_per_group


def _best(df: DataFrame, group: str, position: str, value: Column, width: int, chunk: int) -> DataFrame:
    rows, frame, own = sliding_rows(df.select(group, position, value.alias("_v")), group, position, 0, width - 1, chunk)
    rows = rows.withColumn("_m", F.avg("_v").over(frame)).withColumn("_c", F.count("*").over(frame))
    # a window counts if it is full; a sequence shorter than the window is one window, from its start
    starts = rows.filter(own & ((F.col("_c") == width) | (F.col(position) == 0)))
    best = F.max(F.struct(F.round("_m", 12).alias("m"), (-F.col(position)).alias("i")))
    out = starts.groupBy(group).agg(best.alias("_b"))
    some = F.col("_b.m") > 0
    return out.select(
        group,
        F.when(some, F.col("_b.m")).otherwise(0.0).alias("best"),
        F.when(some, -F.col("_b.i")).otherwise(-1).cast("bigint").alias("start"),
    )


def densest_share(df: DataFrame, group: str = "doc_id", position: str = "sent_idx", score: str = "p",
                  limit: float = V.AI_SENTENCE_LIMIT, width: int = V.ISLAND_WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Highest share of scores at or above ``limit`` in a window, with its earliest start (-1 if the share is zero)."""
    return _best(df, group, position, F.when(F.col(score) >= limit, 1.0).otherwise(0.0), width, chunk)


def densest_mean(df: DataFrame, group: str = "doc_id", position: str = "sent_idx", score: str = "p",
                 width: int = V.ISLAND_WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Highest mean score of a window, with its earliest start."""
    return _best(df, group, position, F.col(score), width, chunk)


def window_scores(df: DataFrame, best: DataFrame, group: str = "doc_id", position: str = "sent_idx", score: str = "p",
                  width: int = V.ISLAND_WIDTH) -> DataFrame:
    """The scores inside each group's best window, in order: at most ``width`` values per group."""
    inside = df.join(best.filter("start >= 0"), group).filter(
        (F.col(position) >= F.col("start")) & (F.col(position) < F.col("start") + width)
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("i"), F.col(score).alias("s"))))
    return inside.groupBy(group).agg(F.transform(ordered, lambda x: x["s"]).alias("scores"))


def neighbourhoods(df: DataFrame, group: str = "doc_id", position: str = "sent_idx", score: str = "p", reach: int = 2,
                   chunk: int = CHUNK) -> DataFrame:
    """Adds ``neighborhood_mean`` (rounded to four digits) and ``isolated`` (below 0.35)."""
    rows, frame, own = sliding_rows(df, group, position, reach, reach, chunk)
    rows = rows.withColumn("neighborhood_mean", F.round(F.avg(score).over(frame), 4)).filter(own).drop("_chunk")
    return rows.withColumn("isolated", F.col("neighborhood_mean") < 0.35)


def mark_islands(df: DataFrame, best: DataFrame, group: str = "doc_id", position: str = "sent_idx") -> DataFrame:
    """Adds ``in_island``: the row lies in the six positions from the best window's start."""
    start = F.col("start")
    inside = (start >= 0) & (F.col(position) >= start) & (F.col(position) < start + V.ISLAND_WIDTH)
    return df.join(best.select(group, "start"), group, "left").withColumn("in_island", F.coalesce(inside, F.lit(False))).drop("start")


def top_sentences(df: DataFrame, group: str = "doc_id", position: str = "sent_idx", score: str = "p",
                  sentence: str = "sentence", k: int = 20, limit: float = V.AI_SENTENCE_LIMIT) -> DataFrame:
    """The k highest sentences of each group (earlier first on ties), then those at or above ``limit``."""
    top = top_n_per_group(df, group, [F.col(score).desc(), F.col(position)], k, salt_by=[position], rank="rank")
    return (
        top.filter(F.col(score) >= limit)
        .withColumn("templates", template_names(sentence))
        .withColumn(sentence, F.substring(sentence, 1, 200))
    )
