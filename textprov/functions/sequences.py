"""Expressions over the score array of one document, position by position. No shuffle: a document is one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .scores import context_calibrated, fuse, gate_calibrated
from .text import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """Mean in array order, null for an empty array."""
    return let(values, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)))


def fuse_arrays(stat: Column, deep: Column, bias: float = V.FUSION_BIAS) -> Column:
    """Element-wise fusion; a missing array leaves the other."""
    return F.when(deep.isNull(), stat).when(stat.isNull(), deep).otherwise(
        F.zip_with(stat, deep, lambda a, b: fuse(a, b, bias))
    )


def context_array(values: Column) -> Column:
    return let(values, lambda v: let(mean(v), lambda m: F.transform(v, lambda p: context_calibrated(p, m))))


def gate_array(values: Column) -> Column:
    return let(values, lambda v: let(mean(v), lambda m: F.transform(v, lambda p: gate_calibrated(p, m))))


def window_means(values: Column, width: int = V.ISLAND_WIDTH) -> Column:
    """Mean of every full window; a document shorter than the window is one window."""
    def over(v: Column) -> Column:
        n = F.size(v)
        w = F.least(n, F.lit(width))
        return F.when(n == 0, F.array().cast("array<double>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n - w, F.lit(0))), lambda i: total(F.slice(v, i + 1, w)) / w)
        )
    return let(values, over)


def window_shares(values: Column, limit: float = V.AI_SENTENCE_LIMIT, width: int = V.ISLAND_WIDTH) -> Column:
    return window_means(F.transform(values, lambda p: F.when(p >= limit, 1.0).otherwise(0.0)), width)


def best_window(measures: Column) -> Column:
    """``struct(best, start)``: the highest measure and its earliest start; (0, -1) if nothing is above zero.

    Measures are compared after rounding to twelve digits.
    """
    ranked = F.transform(measures, lambda m, i: F.struct(F.round(m, 12).alias("m"), (-i).alias("i")))
    return let(
        F.array_max(ranked),
        lambda b: F.when(b["m"] > 0, F.struct(b["m"].alias("best"), (-b["i"]).alias("start")))
        .otherwise(F.struct(F.lit(0.0).alias("best"), F.lit(-1).alias("start"))),
    )


def neighbourhood(values: Column, i: Column, reach: int = 2) -> Column:
    """Mean of the values around position ``i``, clipped at both ends."""
    first = F.greatest(i - reach, F.lit(0))
    return mean(F.slice(values, first + 1, i + reach - first + 1))


def char_weighted(values: Column, lengths: Column) -> Column:
    """Sum of score times length over the sum of lengths (at least one)."""
    return total(F.zip_with(values, lengths, lambda p, n: p * n)) / F.greatest(
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(1)
    )
