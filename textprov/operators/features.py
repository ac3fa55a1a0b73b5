"""Features of documents from sentence rows. All are partial aggregations: one small row per document is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import connective_count, hit_score, is_long, is_short, template_hits


def document_features(sentences: DataFrame, group: str = "doc_id", sentence: str = "sentence") -> DataFrame:
    """Length statistics (population deviation), connective density, template totals, shares of long and short."""
    s = F.col(sentence)
    rows = sentences.select(
        group,
        F.length(s).alias("_len"),
        connective_count(s).alias("_conn"),
        hit_score(template_hits(s)).alias("_tpl"),
        is_long(s).cast("double").alias("_long"),
        is_short(s).cast("double").alias("_short"),
    )
    mean, std = F.avg("_len"), F.stddev_pop("_len")
    return rows.groupBy(group).agg(
        F.count("*").alias("n_sentences"),
        mean.alias("avg_sent_len"),
        std.alias("sent_len_std"),
        F.when(mean > 0, std / mean).otherwise(0.0).alias("burstiness_cv"),
        (F.max("_len") - F.min("_len")).cast("bigint").alias("sent_len_range"),
        (F.sum("_conn") / F.greatest(F.sum("_len"), F.lit(1))).alias("connective_density"),
        F.sum("_tpl").alias("template_total"),
        F.avg(F.when(F.col("_tpl") > 0, 1.0).otherwise(0.0)).alias("templated_sent_ratio"),
        F.avg("_long").alias("share_long"),
        F.avg("_short").alias("share_short"),
    )


def burstiness(sentences: DataFrame, group: str = "doc_id", sentence: str = "sentence") -> DataFrame:
    """Coefficient of variation of sentence lengths; zero below two sentences. Empty sentences do not count."""
    n = F.length(sentence)
    rows = sentences.select(group, F.when(n > 0, n).alias("_len"))
    cv = F.stddev_pop("_len") / F.nullif(F.avg("_len"), F.lit(0.0))
    return rows.groupBy(group).agg(F.when(F.count("_len") < 2, 0.0).otherwise(cv).alias("burstiness"))
