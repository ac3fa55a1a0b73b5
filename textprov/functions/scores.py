"""Score expressions: fusion, calibration, tiers, states and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import _col


def _num(c: Column | float) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


def stand_in(c: Column | str, part: int = 0) -> Column:
    """Deterministic stand-in score in [0, 1] from four hex digits of the text's md5; ``part`` picks the digits."""
    return F.conv(F.substring(F.md5(_col(c)), 1 + 4 * part, 4), 16, 10).cast("double") / F.lit(65535.0)


def fuse(stat: Column | str, deep: Column | str, bias: Column | float = V.FUSION_BIAS) -> Column:
    """Two-stream fusion: the other stream if one is missing, the mean if they agree, else weighted by ``bias``."""
    a, b, w = _col(stat), _col(deep), _num(bias)
    return (
        F.when(b.isNull(), a)
        .when(a.isNull(), b)
        .when(F.abs(a - b) > V.FUSION_GAP, w * a + (F.lit(1.0) - w) * b)
        .otherwise((a + b) / 2)
    )


FUSION_STRATEGIES = {
    "stat": lambda a, b: a,
    "equal": lambda a, b: (a + b) / 2,
    "weighted": lambda a, b: a * 0.7 + b * 0.3,
    "max": lambda a, b: F.greatest(a, b),
    "deep": lambda a, b: b,
}


def context_weight(mean: Column | str) -> Column:
    """Weight of the document mean: grows with its distance from one half, bounded."""
    return F.least(F.lit(V.CONTEXT_MAX), F.lit(V.CONTEXT_SLOPE) * F.abs(_col(mean) - 0.5))


def context_calibrated(p: Column | str, mean: Column | str) -> Column:
    p, m = _col(p), _col(mean)
    a = context_weight(m)
    return a * m + (F.lit(1.0) - a) * p


def gate_open(mean: Column | str) -> Column:
    return _col(mean) < V.HUMAN_DOC_GATE


def gate_calibrated(p: Column | str, mean: Column | str) -> Column:
    """Soften sentences above the mean in documents that lean human; leave everything else."""
    p, m = _col(p), _col(mean)
    a = F.least(F.lit(V.SOFTEN_MAX), context_weight(m) * V.SOFTEN_MAX / F.lit(V.CONTEXT_MAX))
    return F.when(gate_open(m) & (p > m), a * m + (F.lit(1.0) - a) * p).otherwise(p)


def final_mix(doc_score: Column | str, perplexity_score: Column | str) -> Column:
    return F.lit(0.9) * _col(doc_score) + F.lit(0.1) * _col(perplexity_score)


# --- labels, tiers, verdicts ------------------------------------------------------------------------------------

def tier(pct: Column | str) -> Column:
    pct = _col(pct)
    return F.when(pct >= V.TIER_HIGH, "high").when(pct >= V.TIER_MEDIUM, "medium").otherwise("human")


def label_is_ai(label: Column | str, count_relabelled: bool = True) -> Column:
    """1 for the AI labels. ``count_relabelled`` also accepts the guard's ``AI`` label."""
    labels = ["high", "medium", "low"] + (["AI"] if count_relabelled else [])
    return F.coalesce(_col(label).isin(labels), F.lit(False)).cast("int")


def prob_is_ai(prob: Column | str, limit: float = 0.4) -> Column:
    """Class by probability; a missing probability counts as one half."""
    return (F.coalesce(_col(prob), F.lit(0.5)) >= limit).cast("int")


def service_state(overall: Column | str, island: Column | str) -> Column:
    return (
        F.when(_col(overall) >= 0.5, V.STATE_HIGH)
        .when(_col(island) >= V.ISLAND_LIMIT, V.STATE_ISLAND)
        .when(_col(overall) >= 0.2, V.STATE_WEAK)
        .otherwise(V.STATE_HUMAN)
    )


def report_verdict(overall: Column | str) -> Column:
    pct = _col(overall) * 100
    return F.when(pct < 40, V.VERDICT_HUMAN).when(pct < 60, V.VERDICT_SUSPECT).otherwise(V.VERDICT_AI)


def graded_state(final: Column | str, high: float = 0.5, suspect: float = 0.35, weak: float = 0.2) -> Column:
    """State of the command-line report: high, suspect, weak, human."""
    p = _col(final)
    return F.when(p >= high, "high").when(p >= suspect, "suspect").when(p >= weak, "weak").otherwise("human")


def suite_verdict(overall: Column | str, island: Column | str) -> Column:
    """Five tiers: 高度疑似, 含AI段, 疑似, 证据不足, 基本人类."""
    p = _col(overall)
    return (
        F.when(p >= 0.5, "高度疑似")
        .when(_col(island) >= V.ISLAND_LIMIT, "含AI段")
        .when(p >= 0.35, "疑似")
        .when(p >= 0.2, "证据不足")
        .otherwise("基本人类")
    )


def bounded_verdict(overall: Column | str, island: Column | str, bound: Column | float) -> Column:
    """Verdict with an adjustable lower bound of the 疑似 tier."""
    p = _col(overall)
    return (
        F.when((p >= 0.5) | (_col(island) >= V.ISLAND_LIMIT), "AI")
        .when(p >= _num(bound), "疑似")
        .when(p >= 0.2, "证据不足")
        .otherwise("基本人类")
    )


def quality_gate(overall: Column | str, threshold: float = 0.35) -> Column:
    return F.when(_col(overall) < threshold, "pass").otherwise("fail")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two float arrays, null if a norm is zero."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
