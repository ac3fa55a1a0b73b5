"""Evaluation: metrics at thresholds, rank AUC, best thresholds, sweeps, audits, group counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import stock_phrase_hits
from ..functions.scores import FUSION_STRATEGIES, bounded_verdict, fuse
from ..functions.text import han_count
from .scale import at_thresholds, cumulative_counts, first_k


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def steps(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... below stop, each computed from the start."""
    out, i = [], 0
    while start + i * step < stop - 1e-12:
        out.append(start + i * step)
        i += 1
    return out


def binary_metrics(df: DataFrame, threshold: float, score: str = "p", label: str = "label", by=()) -> DataFrame:
    """False-positive rate, recall and accuracy at a threshold; a rate over no rows is zero."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    return df.groupBy(*_by(by)).agg(
        F.coalesce(F.avg(F.when(~pos, hit.cast("double"))), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.avg(F.when(pos, hit.cast("double"))), F.lit(0.0)).alias("ai_recall"),
        F.coalesce(F.avg((hit == pos).cast("double")), F.lit(0.0)).alias("acc"),
        F.count("*").alias("n"),
    )


def metric_table(df: DataFrame, thresholds: Sequence[float], score: str = "p", label: str = "label", by=()) -> DataFrame:
    """Recall, false-positive rate, accuracy, precision and F1 at each threshold of a fixed list."""
    c = at_thresholds(df, score, label, thresholds, by)
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("n_pos"), F.col("n_neg")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return c.select(
        *_by(by), "threshold", "tp", "fp", "n_pos", "n_neg",
        ratio(tp, pos).alias("recall"),
        ratio(fp, neg).alias("fpr"),
        ratio(tp + neg - fp, pos + neg).alias("acc"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, tp + fp + pos).alias("f1"),
    )


def rank_auc(df: DataFrame, score: str = "p", label: str = "label", by=()) -> DataFrame:
    """Exact rank AUC; ties count one half; null if a class is empty."""
    by = _by(by)
    c = cumulative_counts(df, score, label, by)
    lost = F.sum(F.col("n_pos").cast("double") * (F.col("neg_above") + F.col("n_neg") / 2))
    pairs = F.sum("n_pos").cast("double") * F.sum("n_neg")
    return c.groupBy(*by).agg((1 - lost / F.nullif(pairs, F.lit(0.0))).alias("auc"),
                              F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def best_f1_threshold(df: DataFrame, score: str = "p", label: str = "label", by=()) -> DataFrame:
    """The threshold of highest F1 among the scores that occur; the lowest wins ties."""
    by = _by(by)
    c = cumulative_counts(df, score, label, by)
    totals = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("_pos")
    )
    c = c.join(totals, by) if by else c.withColumn("_pos", totals.scalar())
    tp, fp = F.col("pos_above") + F.col("n_pos"), F.col("neg_above") + F.col("n_neg")
    f1 = F.round(2 * tp / (tp + fp + F.col("_pos")), 12)
    best = c.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("t"))).alias("b"))
    return best.select(*by, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def holdout_quality(df: DataFrame, threshold: float = 0.5, score: str = "p", label: str = "label") -> DataFrame:
    """Accuracy, F1 and AUC of a scored hold-out, one row."""
    m = metric_table(df, [threshold], score, label).select("acc", "f1")
    return m.withColumn("auc", rank_auc(df, score, label).select("auc").scalar())


# --- sweeps ------------------------------------------------------------------------------------------------------

def cost_sweep(df: DataFrame, score: str = "p", label: str = "label", fp_cost: float = 3.0, fn_cost: float = 1.0,
               thresholds: Sequence[float] | None = None) -> DataFrame:
    """Cost, false-positive rate and recall at each threshold (0.30 to 0.69 by default)."""
    c = at_thresholds(df, score, label, thresholds or steps(0.30, 0.70, 0.01))
    fn = F.col("n_pos") - F.col("tp")
    return c.select(
        F.round("threshold", 2).alias("threshold"), F.col("fp"), fn.alias("fn"),
        (fp_cost * F.col("fp") + fn_cost * fn).alias("cost"),
        (F.col("fp") / F.nullif("n_neg", F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif("n_pos", F.lit(0))).alias("recall"),
    )


def cheapest_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold of least cost, one row."""
    best = sweep.agg(F.min(F.struct("cost", "threshold", "fpr", "recall")).alias("b"))
    return best.select("b.*")


BIASES = [0.0, 0.2, 0.35, 0.5, 0.65, 0.8, 1.0]  # fixed values


def _per_bias(df: DataFrame, stat: str, deep: str, label: str, biases: Sequence[float]) -> DataFrame:
    fused = F.array(*[F.struct(F.lit(b).alias("bias"), fuse(stat, deep, b).alias("p")) for b in biases])
    return df.select(F.col(label).alias("label"), F.inline(fused))


def recall_at_budget(counts: DataFrame, by=(), budget: float = 0.03, pick: str = "first") -> DataFrame:
    """Recall where the false-positive rate stays within the budget: at the first such threshold, or the highest."""
    by = _by(by)
    fpr = F.coalesce(F.col("fp") / F.nullif("n_neg", F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif("n_pos", F.lit(0)), F.lit(0.0))
    ok = counts.filter(fpr <= budget).select(*by, "threshold", recall.alias("recall"))
    if pick == "first":
        best = F.min(F.struct("threshold", "recall"))
    else:
        best = F.max(F.struct("recall", (-F.col("threshold")).alias("nt")))
    out = ok.groupBy(*by).agg(best.alias("b"))
    t = F.col("b.threshold") if pick == "first" else -F.col("b.nt")
    return out.select(*by, F.round(t, 2).alias("budget_threshold"), F.col("b.recall").alias("recall_at_budget"))


def bias_sweep(df: DataFrame, threshold: float = 0.345, stat: str = "p_stat", deep: str = "p_deep", label: str = "label",
               biases: Sequence[float] = BIASES) -> DataFrame:
    """Per fusion bias: recall, false-positive rate, ``score = recall - 2 fpr`` and recall within a 3 % budget."""
    rows = _per_bias(df, stat, deep, label, biases)
    m = metric_table(rows, [threshold], "p", "label", by="bias").select("bias", "recall", "fpr")
    b = recall_at_budget(at_thresholds(rows, "p", "label", steps(0.2, 0.65, 0.02), by="bias"), by="bias")
    return m.join(b, "bias", "left").withColumn("score", F.col("recall") - 2 * F.col("fpr"))


VERDICT_BOUNDS = [0.35, 0.40, 0.45, 0.50]  # fixed values


def verdict_sweep(docs: DataFrame, overall: str = "overall", island: str = "island",
                  bounds: Sequence[float] = VERDICT_BOUNDS) -> DataFrame:
    """Of human documents, how many each lower bound accuses, and how many it accuses outright."""
    verdicts = F.array(*[F.struct(F.lit(b).alias("bound"), bounded_verdict(overall, island, b).alias("v")) for b in bounds])
    rows = docs.select(F.inline(verdicts))
    return rows.groupBy("bound").agg(
        F.count_if(F.col("v").isin("AI", "疑似")).alias("accused"), F.count_if(F.col("v") == "AI").alias("outright"),
        F.count("*").alias("n"),
    )


def before_after_metrics(df: DataFrame, before: str, after: str, thresholds: Sequence[float], label: str = "label",
                         by=()) -> DataFrame:
    """Recall and false-positive rate before and after calibration, in one table with column ``stage``."""
    both = F.array(F.struct(F.lit("before").alias("stage"), F.col(before).alias("p")),
                   F.struct(F.lit("after").alias("stage"), F.col(after).alias("p")))
    rows = df.select(*_by(by), F.col(label).alias("label"), F.inline(both))
    return metric_table(rows, thresholds, "p", "label", by=[*_by(by), "stage"])


# --- streams and strategies --------------------------------------------------------------------------------------

def unpivot_streams(df: DataFrame, streams: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per row and stream: ``keep, stream, p``."""
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(k).alias("stream"), c.alias("p")) for k, c in streams.items()])))


def stream_separation(df: DataFrame, streams: dict[str, Column], label: str = "label") -> DataFrame:
    """AUC, class means and their difference per score stream."""
    rows = unpivot_streams(df, streams, [label])
    means = rows.groupBy("stream").agg(
        F.avg(F.when(F.col(label) == 1, F.col("p"))).alias("mean_ai"), F.avg(F.when(F.col(label) == 0, F.col("p"))).alias("mean_human")
    )
    auc = rank_auc(rows, "p", label, by="stream").select("stream", "auc")
    return means.join(auc, "stream").withColumn("separation", F.col("mean_ai") - F.col("mean_human"))


def fusion_strategies(stat: str = "p_stat", deep: str = "p_deep") -> dict[str, Column]:
    return {k: f(F.col(stat), F.col(deep)) for k, f in FUSION_STRATEGIES.items()}


def agreement(df: DataFrame, thresholds: Sequence[float] = (0.5, 0.45, 0.4), score: str = "p", label: str = "label") -> DataFrame:
    """Agreement, true precision and recall against an outside labeller at each threshold."""
    return metric_table(df, thresholds, score, label).select("threshold", F.col("acc").alias("agreement"), "precision", "recall")


# --- audits and counts -------------------------------------------------------------------------------------------

def audit_pools(df: DataFrame, pool: str, ids, sample: int | None = None, min_han: int = 20, require_han: bool = True,
                text: str = "text", expect: str = "expect", seed: int = 3) -> DataFrame:
    """Per pool, over all rows or a hash-ordered sample of each: size, mean Han length, share with stock phrases, warning
    for human pools."""
    rows = df.filter(han_count(text) >= min_han) if require_han else df
    rows = _audited(rows, pool, ids, sample, seed)
    rate = F.avg((stock_phrase_hits(text) >= 1).cast("double"))
    out = rows.groupBy(pool, expect).agg(F.count("*").alias("n"), rate.alias("phrase_rate"), F.avg(han_count(text)).alias("mean_len"))
    return out.withColumn("warn", (F.col(expect) == "human") & (F.col("phrase_rate") > 0.15))


def audit_scores(df: DataFrame, pool: str, ids, sample: int | None = None, score: str = "p", expect: str = "expect",
                 seed: int = 7) -> DataFrame:
    """Per pool, over all rows or a hash-ordered sample of each: mean score, share on the wrong side of one half, warning
    above a tenth."""
    rows = _audited(df, pool, ids, sample, seed)
    wrong = F.when(F.col(expect) == "human", F.col(score) >= 0.5).otherwise(F.col(score) < 0.5)
    out = rows.groupBy(pool, expect).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(wrong.cast("double")).alias("wrong_rate")
    )
    return out.withColumn("warn", F.col("wrong_rate") > 0.1)


def _audited(df: DataFrame, pool: str, ids, sample: int | None, seed: int) -> DataFrame:
    if sample is None:
        return df
    return first_k(df, ids, df.groupBy(pool).agg(F.lit(int(sample)).alias("k")), seed, group=[pool])


def label_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def marginal_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of each column, all in one scan: ``dimension, value, n``."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Open issues per severity, most severe first, with an alert on any high one."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "med", 1).when(F.col("severity") == "low", 2).otherwise(3)
    out = issues.filter(F.col("status") == "open").groupBy("severity").agg(F.count("*").alias("n_open"))
    return out.withColumn("rank", rank).withColumn("alert", F.col("severity") == "high").orderBy("rank", "severity")


def open_issues(issues: DataFrame) -> DataFrame:
    """Open issues in order of severity, description cut to fifty characters."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "med", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return issues.filter(F.col("status") == "open").withColumn("rank", rank).withColumn(
        "description", F.substring("description", 1, 50)
    ).orderBy("rank", "id")


#: log2 of the number of registers of a sketch; its relative standard error is 1.04 / sqrt(registers).
SKETCH_BITS = 14


def sketch_error(bits: int = SKETCH_BITS) -> float:
    return 1.04 / (1 << bits) ** 0.5


def distinct_sketches(df: DataFrame, column: str, by, bits: int = SKETCH_BITS) -> DataFrame:
    """One mergeable sketch (HyperLogLog, a few KB) of a column's values and the number of rows for each partition key.

    Store them next to the data: unions of partitions, and partitions that come later, are then counted without a rescan.
    """
    by = [by] if isinstance(by, str) else list(by)
    value = F.col(column)
    value = value if dict(df.dtypes)[column] in ("string", "binary", "int", "bigint") else value.cast("string")
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, bits).alias("sketch"), F.count(column).alias("n"))


def merged_sketches(sketches: DataFrame, by=()) -> DataFrame:
    """Estimated distinct values and rows over all stored sketches, or per ``by``; only sketches are read."""
    by = [by] if isinstance(by, str) else list(by)
    out = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))
    return out.withColumn("n_estimated", F.hll_sketch_estimate("sketch"))


def distinct_counts(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(n.cast("bigint").alias("n_distinct"), F.count(column).alias("n"))
