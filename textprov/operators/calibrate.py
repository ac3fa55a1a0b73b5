"""Calibration over sentence tables, where a group may hold any share of the rows."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import context_calibrated, gate_calibrated, gate_open
from .scale import with_group_stats

# Reliability bins, closed below and open above.
BINS = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0)]


def context_calibrate(df: DataFrame, group: str = "doc_id", position: str = "sent_idx", score: str = "p",
                      out: str = "p_cal") -> DataFrame:
    """Pull every score towards its group's (unweighted) mean, the more the surer the mean."""
    rows = with_group_stats(df, group, position, [F.avg(score).alias("_mean")])
    return rows.withColumn(out, context_calibrated(score, "_mean")).drop("_mean")


def gate_calibrate(df: DataFrame, group: str = "doc_id", position: str = "sent_idx", score: str = "p",
                   out: str = "p_cal") -> DataFrame:
    """Soften high scores in groups that lean human. ``applied`` tells which groups were touched."""
    rows = with_group_stats(df, group, position, [F.avg(score).alias("_mean")])
    return rows.withColumn(out, gate_calibrated(score, "_mean")).withColumn("applied", gate_open("_mean")).drop("_mean")


def fit_isotonic(df: DataFrame, score: str = "p", label: str = "label") -> IsotonicRegressionModel:
    """Isotonic map from score to probability; predictions interpolate and stay at the end values outside."""
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("f")).agg(
        F.avg(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w")
    )
    model = IsotonicRegression(featuresCol="f", labelCol="y", weightCol="w", predictionCol="p_iso")
    return model.fit(rows)


def isotonic_curve(model: IsotonicRegressionModel) -> tuple[list[float], list[float]]:
    return [float(x) for x in model.boundaries], [float(y) for y in model.predictions]


def isotonic_segments(spark: SparkSession, model: IsotonicRegressionModel) -> DataFrame:
    """The fitted map as rows: ``x0, x1, y0, slope`` for scores from x0 up to (not including) x1, from the least to the greatest double."""
    xs, ys = isotonic_curve(model)
    knots = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(xs, ys))], "i int, x double, y double")
    after = knots.select((F.col("i") - 1).alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    inner = knots.join(after, "i").filter(F.col("x1") > F.col("x")).select(
        F.col("x").alias("x0"), "x1", F.col("y").alias("y0"), ((F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x"))).alias("slope")
    )
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    ends = knots.agg(F.min("x").alias("a"), F.min_by("y", "i").alias("ya"), F.max("x").alias("b"), F.max_by("y", "i").alias("yb"))
    flat = F.inline(F.array(
        F.struct(low.alias("x0"), F.col("a").alias("x1"), F.col("ya").alias("y0"), F.lit(0.0).alias("slope")),
        F.struct(F.col("b").alias("x0"), high.alias("x1"), F.col("yb").alias("y0"), F.lit(0.0).alias("slope")),
    ))
    return inner.unionByName(ends.select(flat))


def isotonic_scores(df: DataFrame, model: IsotonicRegressionModel, score: str = "p", out: str = "p_iso", buckets: int = 1024) -> DataFrame:
    """Rows with the fitted probability of their score: an as-of join of scores with knots.

    Each segment of the map is written for every bucket of scores that it touches, so a row meets, by equality on the
    bucket, only the few segments of its own; an interval condition picks the one. There are at most as many segment rows
    as knots and buckets together, whatever the number of rows. A null score has a null probability; a score that is no
    number lies, as in Spark's order, above all others.
    """
    bucket = lambda x: F.least(F.greatest(F.floor(x * buckets), F.lit(-1)), F.lit(buckets))  # noqa: E731  -1 and `buckets`: all scores outside [0, 1)
    first = F.when(F.col("x0") == float("-inf"), F.lit(-1)).otherwise(bucket(F.col("x0")))
    last = F.when(F.col("x1") == float("inf"), F.lit(buckets)).otherwise(bucket(F.col("x1")))
    segments = isotonic_segments(df.sparkSession, model).withColumn("_b", F.explode(F.sequence(first, last)))
    p = F.col(score).cast("double")
    plain = F.when(F.isnan(p) | (p == float("inf")), F.lit(buckets)).when(p == float("-inf"), F.lit(-1)).otherwise(bucket(p))
    rows = df.withColumn("_p", p).withColumn("_b", plain.cast("bigint"))
    own, x0, x1, y0, slope = (F.col(c) for c in ("r._p", "s.x0", "s.x1", "s.y0", "s.slope"))
    inside = (F.col("r._b") == F.col("s._b")) & (own >= x0) & ((own < x1) | (x1 == float("inf")))
    at = F.when(slope == 0, y0).otherwise(y0 + slope * (own - x0))
    return rows.alias("r").join(segments.alias("s"), inside, "left").select(*[F.col(f"r.`{c}`") for c in df.columns], at.alias(out))


def isotonic_map(model: IsotonicRegressionModel):
    """The fitted map as a column function, so that it can run inside arrays: ``isotonic_map(m)(column)``."""
    xs, ys = isotonic_curve(model)
    bx, by = F.array(*[F.lit(x) for x in xs]), F.array(*[F.lit(y) for y in ys])

    def apply(p: Column) -> Column:
        k = F.size(F.filter(bx, lambda b: b <= p))
        x0, x1, y0, y1 = F.get(bx, k - 1), F.get(bx, k), F.get(by, k - 1), F.get(by, k)
        inner = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (p - x0) / F.nullif(x1 - x0, F.lit(0.0)))
        return F.when(p.isNull(), None).when(k == 0, F.lit(ys[0])).when(k >= len(xs), F.lit(ys[-1])).otherwise(inner)

    return apply


def brier(df: DataFrame, score: str = "p", label: str = "label", by=()) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    err = F.pow(F.col(score) - F.col(label), F.lit(2.0))
    return df.groupBy(*by).agg(F.avg(err).alias("brier"), F.count(err).alias("n"))


def reliability(df: DataFrame, score: str = "p", label: str = "label", closed_last: bool = False) -> DataFrame:
    """Mean score, share of positives and size of each bin; empty bins are left out.

    A score of exactly one falls into no bin unless ``closed_last``.
    """
    p = F.col(score)
    low = None
    for i, (lo, hi) in enumerate(BINS):
        inside = (p >= lo) & ((p <= hi) if closed_last and i == len(BINS) - 1 else (p < hi))
        low = F.when(inside, lo) if low is None else low.when(inside, lo)
    return (
        df.withColumn("bin_low", low)
        .filter(F.col("bin_low").isNotNull())
        .groupBy("bin_low")
        .agg(F.avg(score).alias("mean_predicted"), F.avg(label).alias("actual_rate"), F.count("*").alias("n"))
    )
